"""Frames as a Spark data source: filters on file and frame number decide what is read.

``write_index`` finds the frames of every byte range once. ``read_indexed`` then
scans through the index: one partition per byte range, and filters on
``file_id``, ``file_path`` and ``source_struct_id`` are pushed down, so that ranges
without a wanted frame are never opened and other frames are skipped unparsed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema

from .files import absolute, file_system
from .frames import FRAMES_PER_BATCH, INDEXED_FRAME, SPLIT_BYTES, frame_ranges, open_frames

FORMAT = "atomsift_frames"
_FILE_COLUMNS = ("file_id", "file_path")
_FRAME_COLUMN = "source_struct_id"


@dataclass
class FrameRange(D.InputPartition):
    """A byte range, and which of its frames are wanted (None: all between low and high)."""

    row: dict
    low: int
    high: int
    wanted: frozenset | None


@dataclass
class Conditions:
    """What pushed filters leave: conditions on files, and frame numbers."""

    files: list = field(default_factory=list)  # (column, kind, value)
    low: int = 0
    high: int = (1 << 31) - 1
    wanted: frozenset | None = None

    def take(self, f: D.Filter) -> bool:
        """Whether the filter is honoured completely."""
        column = ".".join(getattr(f, "attribute", ()))
        if column not in (*_FILE_COLUMNS, _FRAME_COLUMN):
            return False
        if isinstance(f, D.IsNotNull):
            return True  # the key columns have no nulls
        if isinstance(f, (D.EqualTo, D.EqualNullSafe)):
            kind, values = "in", (f.value,)
        elif isinstance(f, D.In):
            kind, values = "in", tuple(f.value)
        else:
            bounds = {
                D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=",
            }
            kind = bounds.get(type(f))
            if kind is None or f.value is None:
                return False
            values = (f.value,)
        if kind == "in":
            values = tuple(v for v in values if v is not None)  # null equals nothing
        if column in _FILE_COLUMNS:
            self.files.append((column, kind, values))
        elif kind == "in":
            self.wanted = frozenset(values) if self.wanted is None else self.wanted & frozenset(values)
        elif kind.startswith(">"):
            self.low = max(self.low, values[0] + (kind == ">"))
        else:
            self.high = min(self.high, values[0] - (kind == "<"))
        return True

    def expression(self):
        """Which byte ranges of the index can hold wanted frames."""
        out = (pc.field("n") > 0) & (pc.field("first") <= self.high) & (pc.field("first") + pc.field("n") > self.low)
        for column, kind, values in self.files:
            at = pc.field(column)
            if kind == "in":
                out &= at.isin(pa.array(values, pa.string() if column == "file_path" else pa.int32()))
            elif kind.startswith(">"):
                out &= at >= values[0] if kind == ">=" else at > values[0]
            else:
                out &= at <= values[0] if kind == "<=" else at < values[0]
        return out

    def inside(self, row: dict) -> frozenset | None:
        if self.wanted is None:
            return None
        return frozenset(w for w in self.wanted if row["first"] <= w < row["first"] + row["n"] and self.low <= w <= self.high)


class FramesReader(D.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.conditions = path, Conditions()

    def pushFilters(self, filters):
        return [f for f in filters if not self.conditions.take(f)]

    def partitions(self):
        system, inner = file_system(absolute(self.path))
        table = ds.dataset(inner, filesystem=system, format="parquet").to_table(filter=self.conditions.expression())
        out = []
        for row in table.sort_by([("file_id", "ascending"), ("start", "ascending")]).to_pylist():
            wanted = self.conditions.inside(row)
            if wanted is None or wanted:
                out.append(FrameRange(row, self.conditions.low, self.conditions.high, wanted))
        return out

    def read(self, partition):
        if partition is None:
            return
        row, schema, out = partition.row, to_arrow_schema(INDEXED_FRAME), []

        def want(i):
            at = row["first"] + i
            return partition.low <= at <= partition.high if partition.wanted is None else at in partition.wanted

        for i, frame in enumerate(open_frames(row, want)):
            if frame is not None:
                key = {"file_id": row["file_id"], "file_path": row["file_path"], _FRAME_COLUMN: row["first"] + i}
                out.append({**key, **frame})
            if len(out) >= FRAMES_PER_BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


class FramesSource(D.DataSource):
    """``load(index)``: all frames that the index at that path names."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return INDEXED_FRAME

    def reader(self, schema):
        if "path" not in self.options:
            raise ValueError(f'{FORMAT}: load(...) needs the path of an index made by "write_index"')
        return FramesReader(self.options["path"])


def write_index(files: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Numbers the frames of the listed files (file_id, file_path, length) per byte range, as Parquet at ``path``."""
    frame_ranges(files, split_bytes).write.parquet(path)
    return path


def read_indexed(spark: SparkSession, index: str) -> DataFrame:
    """file_id, file_path, source_struct_id and the frame, for all frames of an index."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramesSource)
    return spark.read.format(FORMAT).load(index)
