"""The benchmark tables seen as structures, atoms and descriptor matrices.

file = nation of the ordering customer, frame = order, atom = line item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import assign_row_ids, rank_within

LINE_ORDER = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )


def numbered_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line items with row_id, the position in LINE_ORDER, and the wanted columns."""
    return assign_row_ids(table(spark, sf_dir, "lineitem"), LINE_ORDER, keep=columns)


def line_features() -> Column:
    """Four raw features of a line item."""
    return F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x")


def scaled_features() -> Column:
    """The same features brought to comparable ranges by exact factors."""
    return F.array(
        F.col("l_quantity"), F.col("l_extendedprice") / 1024.0, F.col("l_discount") * 512.0, F.col("l_tax") * 512.0
    ).alias("x")


def line_matrix(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    features = scaled_features() if scaled else line_features()
    return numbered_lines(
        spark, sf_dir, "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    ).select("row_id", features)


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey -> file_id."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("file_id"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def filemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id -> path; the files of region 0 are left unmapped on purpose."""
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_regionkey") > 0)
        .select(F.col("n_nationkey").cast("int").alias("file_id"), F.col("n_name").alias("file_path"))
    )


def line_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, file_id, struct_id, atom_id, symbol, is_fixed, source_struct_id."""
    lines = numbered_lines(spark, sf_dir, "l_orderkey", "l_returnflag", "l_linestatus")
    # atom_id is the distance to the first line of the order, so no window is needed.
    starts = lines.groupBy(F.col("l_orderkey").alias("_k")).agg(F.min("row_id").alias("_first"))
    files = frame_files(spark, sf_dir).select("o_orderkey", "file_id")
    atoms = lines.join(starts, F.col("l_orderkey") == F.col("_k")).join(
        files, F.col("l_orderkey") == F.col("o_orderkey")
    )
    return atoms.select(
        "row_id",
        F.col("file_id").cast("int").alias("file_id"),
        F.col("l_orderkey").cast("int").alias("struct_id"),
        (F.col("row_id") - F.col("_first")).cast("int").alias("atom_id"),
        F.col("l_returnflag").alias("symbol"),
        (F.col("l_linestatus") == "F").alias("is_fixed"),
        F.col("l_orderkey").cast("int").alias("source_struct_id"),
    )


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, source_struct_id (position of the order in its file), o_orderkey."""
    frames = frame_files(spark, sf_dir).select("file_id", "o_orderkey")
    return rank_within(frames, ["file_id"], ["o_orderkey"], "source_struct_id").select(
        F.col("file_id").cast("int").alias("file_id"),
        F.col("source_struct_id").cast("int").alias("source_struct_id"),
        "o_orderkey",
    )


def line_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms without identity: frame, symbol and a 3-component force."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("struct_id"),
        F.col("l_returnflag").alias("symbol"),
        F.array("l_quantity", "l_discount", "l_tax").alias("force"),
    )


def lattice_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as atoms on integer positions of a periodic box per order."""
    lines = numbered_lines(spark, sf_dir, "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    box = [[52.0, 0.0, 0.0], [0.0, 12.0, 0.0], [0.0, 0.0, 10.0]]
    return lines.select(
        F.col("l_orderkey").alias("struct_id"),
        F.col("row_id").alias("atom_id"),
        F.col("l_returnflag").alias("symbol"),
        F.array(
            F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
        ).alias("pos"),
        F.array(*[F.array(*[F.lit(v) for v in row]) for row in box]).alias("cell"),
        F.array(*[F.lit(True)] * 3).alias("pbc"),
    )
