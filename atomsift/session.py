"""Session helpers: builder defaults, shared checkpoint folder, table materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Texts of a task lie in the JVM and in its Python worker at once, in buffers that double as they grow.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_LOCAL_FALLBACK: dict[str, str] = {}


def local_session(app: str = "atomsift", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session used by tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="atomsift-ckpt-")
    return _LOCAL_FALLBACK[app]


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands Python about ``BATCH_BYTES`` at a time, unless it has a limit of its own."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


_SCOPES: list[list[tuple[SparkSession, str]]] = []
_PATHS: dict[int, str] = {}


def forget_later(spark: SparkSession, path: str) -> None:
    """Has ``path`` deleted at the end of the open :func:`intermediate_tables`, if there is one."""
    if _SCOPES:
        _SCOPES[-1].append((spark, path))


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the copy.

    Cuts the lineage and freezes anything that would not be recomputed
    identically (partition ids, sort positions), also when an executor is lost.
    The copy stays until :func:`release` or the end of :func:`intermediate_tables`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/atomsift/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_later(spark, path)
    copy = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(copy)] = path
    weakref.finalize(copy, _PATHS.pop, id(copy), None)
    return copy


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete copies made by :func:`materialize` that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = _PATHS.pop(id(table), None)
        if path:
            delete_path(table.sparkSession, path)


@contextmanager
def intermediate_tables():
    """Copies that :func:`materialize` makes inside are deleted at the end.

    Results that are still to be read have to be written or collected inside.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            delete_path(spark, path)
