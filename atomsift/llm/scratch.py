"""Intermediate tables in the shared folder, and how they go away."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, delete_path, forget_later


class Scratch:
    """Tables of one run, each written once below ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives a lost executor. ``drop`` and
    ``since`` delete tables that the returned frame no longer needs; what is left goes
    at the end of :func:`atomsift.session.intermediate_tables`, where that is open.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/atomsift/{label}-{uuid.uuid4().hex}"
        forget_later(spark, self.root)
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, label: str = "table", by: str | None = None) -> DataFrame:
        """Writes ``df``, into folders by the values of its last column ``by`` where that is given, and reads it back."""
        path = f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path, partitionBy=by)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by :meth:`keep` that nothing reads any more; other frames are left alone."""
        for kept, path in self.tables:
            if any(kept is t for t in tables):
                delete_path(self.spark, path)
        self.tables = [(k, p) for k, p in self.tables if not any(k is t for t in tables)]

    def since(self, mark: int, *needed: DataFrame) -> None:
        """Delete the tables made after ``mark`` (an earlier ``len(scratch.tables)``) but those that are needed."""
        self.drop(*(k for k, _ in self.tables[mark:] if not any(k is n for n in needed)))
