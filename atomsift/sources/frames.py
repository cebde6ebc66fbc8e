"""Structure files to nested frames, in parallel inside files too."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from ..operators.provenance import number_files
from ..schemas import FRAME
from .files import discover_structure_files, open_binary
from .formats import READERS, format_of

SPLIT_BYTES = 64 << 20
FRAMES_PER_BATCH = 64


def _ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """file_id, file_path, length, start, end: byte ranges of every file, one task each."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    ranges = files.select("file_id", "file_path", F.col("length").cast("bigint").alias("length"), starts.alias("start"))
    return ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("length")))


def open_frames(r: dict, want):
    with open_binary(r["file_path"]) as f:
        yield from READERS[format_of(r["file_path"])](f, r["start"], r["end"], want)


def _count(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["n"] = sum(1 for _ in open_frames(r, lambda i: False))
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("n", pa.int64())))


def _spread_out(ranges: DataFrame) -> DataFrame:
    """One range per task, whatever the size of the listing."""
    count = ranges.count()
    return ranges.repartitionByRange(max(1, min(count, 100_000)), "file_id", "start")


INDEXED_FRAME = T.StructType(
    [
        T.StructField("file_id", T.IntegerType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("source_struct_id", T.IntegerType()),
        *FRAME.fields,
    ]
)


def frame_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges with the number ``first`` of their first frame and how many (``n``) start in them."""
    ranges = _spread_out(_ranges(files, split_bytes))
    counted = ranges.mapInArrow(
        _count, T.StructType([*ranges.schema.fields, T.StructField("n", T.LongType())])
    )
    before = W.partitionBy("file_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("n > 0")


def read_frames(
    files: DataFrame,
    frame_stride: int = 1,
    frames: DataFrame | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Nested frames of the listed files (file_id, file_path, length).

    A first pass finds the frame starts in every byte range and so the frame
    numbers; the second parses only the frames that the stride keeps, or those
    named by ``frames`` (file_id, source_struct_id).
    """
    if frame_stride <= 0:
        raise ValueError("frame_stride must be >= 1.")
    placed = frame_ranges(files, split_bytes)
    if frames is not None:
        wanted = frames.select("file_id", F.col("source_struct_id").cast("bigint").alias("_w")).distinct()
        inside = (F.col("_w") >= F.col("first")) & (F.col("_w") < F.col("first") + F.col("n"))
        keyed = placed.join(wanted.withColumnRenamed("file_id", "_f"), (F.col("file_id") == F.col("_f")) & inside)
        placed = keyed.groupBy(*placed.columns).agg(F.collect_set("_w").alias("wanted"))
    else:
        placed = placed.withColumn("wanted", F.lit(None).cast("array<bigint>"))
    schema = INDEXED_FRAME
    arrow_schema = to_arrow_schema(schema)

    def parse(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keep = None if r["wanted"] is None else set(r["wanted"])

                def want(i, first=r["first"], keep=keep):
                    return (first + i) % frame_stride == 0 if keep is None else first + i in keep

                out = []
                for i, frame in enumerate(open_frames(r, want)):
                    if frame is not None:
                        key = {"file_id": r["file_id"], "file_path": r["file_path"], "source_struct_id": r["first"] + i}
                        out.append({**key, **frame})
                    if len(out) >= FRAMES_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    parsed = _spread_out(placed).mapInArrow(parse, schema)
    return parsed.withColumn("struct_id", F.floor(F.col("source_struct_id") / frame_stride).cast("int"))


def with_sizes(files: DataFrame) -> DataFrame:
    """Adds ``length`` to (file_id, file_path); tasks ask for the sizes."""
    schema = T.StructType([*files.schema.fields, T.StructField("length", T.LongType())])

    def measure(batches):
        for batch in batches:
            sizes = []
            for path in batch.column("file_path").to_pylist():
                with open_binary(path) as f:
                    sizes.append(f.seek(0, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=schema.names)

    return files.mapInArrow(measure, schema)


def load_structures(
    spark: SparkSession,
    roots: Sequence[str],
    patterns: Sequence[str] | str | None = None,
    recursive: bool = True,
    frame_stride: int = 1,
) -> DataFrame:
    """Discover, number and read structure files."""
    return read_frames(number_files(discover_structure_files(spark, roots, patterns, recursive)), frame_stride)


def atoms_of(frames: DataFrame) -> DataFrame:
    """One row per atom with its frame's cell and pbc."""
    keys = ["file_id", "struct_id", "source_struct_id"]
    atoms = frames.select(*keys, "cell", "pbc", F.explode("atoms").alias("a"))
    return atoms.select(*keys, "a.atom_id", "a.symbol", "a.pos", "a.force", "a.is_fixed", "cell", "pbc")


def energies_of(frames: DataFrame) -> DataFrame:
    """file_id, struct_id, energy (null where the file has none)."""
    return frames.select("file_id", "struct_id", "energy")
