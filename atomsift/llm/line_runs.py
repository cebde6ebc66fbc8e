"""Line deduplication over levelled sorted runs of line hashes.

The index holds pairs of a line's hash and a document. A run is a table of such
pairs, bucketed and sorted by the pair; every batch of documents anti-joins its
pairs with all runs, bucket by bucket without moving them, and what is new becomes
a run of the lowest level. When a level has ``fanout`` runs, they are merged into
one run of the next level. A pair is therefore in one run only, however often its
document is given, and adding a batch again after a failure adds nothing.

Buckets are of pairs, not of hashes, so a line that a third of all documents hold
is spread over all buckets.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path
from .scratch import Scratch

# Space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Lines held by a larger share of all pairs than one of so many are broadcast: no more of them can exist.
HOT_SHARE = 50_000
_PAIR = "key BINARY, doc_id BIGINT"


class LineRuns:
    """Runs below ``root``; opening a folder that holds runs goes on with them.

    A run's folder is named by its level and the first and last batch it covers, and
    counts once Spark's writer has finished it. Runs whose batches a higher level
    covers are left over from a merge and ignored.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, fanout: int = 4):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.runs: list[tuple[int, int, int]] = []  # level, first batch, last batch
        for run in sorted(self._finished(), reverse=True):
            if not any(a <= run[1] and run[2] <= b for _, a, b in self.runs):
                self.runs.append(run)
                self.spark.sql(
                    f"CREATE TABLE {self._table(run)} ({_PAIR}) USING parquet CLUSTERED BY (key, doc_id) "
                    f"SORTED BY (key, doc_id) INTO {self.buckets} BUCKETS LOCATION '{self._path(run)}'"
                )

    def _path(self, run) -> str:
        return f"{self.root}/level{run[0]}-batch{run[1]}-{run[2]}-of{self.buckets}"

    def _table(self, run) -> str:
        return f"{self.name}_{run[0]}_{run[1]}_{run[2]}"

    def _finished(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(at) if files.exists(at) else []:
            named = re.fullmatch(r"level(\d+)-batch(\d+)-(\d+)-of(\d+)", status.getPath().getName())
            if not named or not files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                continue
            level, first, last, buckets = map(int, named.groups())
            if buckets != self.buckets:
                raise ValueError(f"the runs in {self.root} have {buckets} buckets, not {self.buckets}")
            yield level, first, last

    def _write(self, pairs: DataFrame, run) -> None:
        delete_path(self.spark, self._path(run))  # left by a writer that did not finish
        sorted_run = pairs.write.bucketBy(self.buckets, "key", "doc_id").sortBy("key", "doc_id")
        sorted_run.option("path", self._path(run)).format("parquet").saveAsTable(self._table(run))
        self.runs.append(run)

    def add(self, pairs: DataFrame) -> None:
        """One batch of ``(key, doc_id)``: pairs that no run has become a run; full levels are merged."""
        fresh = pairs.select("key", "doc_id").repartition(self.buckets, "key", "doc_id").distinct()
        for run in self.runs:
            fresh = fresh.join(self.spark.table(self._table(run)).hint("merge"), ["key", "doc_id"], "left_anti")
        batch = 1 + max((last for _, _, last in self.runs), default=-1)
        self._write(fresh, (0, batch, batch))
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self._write(self._union(full).distinct(), (level + 1, min(r[1] for r in full), max(r[2] for r in full)))
            self._forget(full)
            level += 1

    def _forget(self, runs) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
            delete_path(self.spark, self._path(run))
        self.runs = [r for r in self.runs if r not in runs]

    def _union(self, runs) -> DataFrame:
        return reduce(DataFrame.union, [self.spark.table(self._table(run)) for run in runs])

    def pairs(self) -> DataFrame:
        """All ``(key, doc_id)``, each once."""
        return self._union(self.runs) if self.runs else self.spark.createDataFrame([], _PAIR)

    def delete(self) -> None:
        self._forget(list(self.runs))


def line_pairs(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(key, doc_id)`` of every line whose key has ``least_chars`` code points; repeats stay."""
    lines = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")
    )
    lines = lines.select("doc_id", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= least_chars)
    return lines.select(F.unhex(F.md5(F.translate("line", _UPPER, _LOWER))).alias("key"), "doc_id")


def line_key(line: bytes) -> bytes:
    """The same hash of one UTF-8 line."""
    return hashlib.md5(line.strip(BLANKS.encode()).lower()).digest()


def _cut(batches):
    """Removes the lines whose keys are in the row's list."""
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("gone")
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(texts, lists):
            lines = (text.as_buffer() or pa.py_buffer(b"")).to_pybytes().split(b"\n")
            stay = lines
            if gone.is_valid:
                known = set(gone.as_py())
                stay = [line for line in lines if line_key(line) not in known]
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_lines, pa.int64()),
                pa.array(n_dropped, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_lines", "n_dropped", "text"],
        )


def drop_lists(runs: LineRuns, scratch: Scratch, least_docs: int) -> DataFrame:
    """``(doc_id, gone)``: the keys that ``least_docs`` documents or more hold, but for the largest document of each."""
    pairs = runs.pairs()
    counted = pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    common = scratch.keep(counted.where(F.col("n") >= least_docs), "common-lines")
    held = common.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > held / HOT_SHARE
    few = F.broadcast(common.where(hot))  # fewer than HOT_SHARE rows, since their sum is at most all
    found = pairs.join(few, "key").union(pairs.join(common.where(~hot), "key"))
    return found.where("doc_id <> last").groupBy("doc_id").agg(F.collect_list("key").alias("gone"))


def dedup_lines(
    docs: DataFrame, scratch: Scratch, least_chars: int = 40, least_docs: int = 5, batches: int = 6, fanout: int = 4
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` for every row, repeated lines removed.

    Lines end at ``\\n``. A line's key is the line without blanks at both ends, A-Z
    lower-cased. Keys of at least ``least_chars`` code points that at least
    ``least_docs`` different documents hold lose all their lines but those of the
    document with the largest id. The other lines stay, joined by ``\\n``.

    The documents come in ``batches`` parts by their id; the parts only bound the
    size of a run, the result does not depend on them. Null and empty texts are one
    empty line and come back empty. Rows with a null id are returned whole and count
    nowhere. Rows of one id are one document: its lines count once, and all its rows
    lose or keep a line together. An empty table gives an empty table; other columns
    are not read.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    dealt = scratch.keep(line_pairs(docs, least_chars).withColumn("batch", part), "line-pairs", by="batch")
    runs = LineRuns(scratch.spark, f"{scratch.root}/line-runs", fanout=fanout)
    for batch in range(batches):
        runs.add(dealt.where(F.col("batch") == batch))
    scratch.drop(dealt)
    lists = scratch.keep(drop_lists(runs, scratch, least_docs), "drop-lists")
    runs.delete()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # merged at every size: a join that is broadcast as long as the lists are small would hide what it costs
    return rows.join(lists.hint("merge"), "doc_id", "left").mapInArrow(
        _cut, "doc_id long, n_lines long, n_dropped long, text string"
    )
