"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before kept; all but the last return the columns of ``documents``. Stages limit the
bytes of Arrow batches in their session, so that memory does not follow partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomsift.llm import decontaminate, ngram_join, packing, pii, quality
from atomsift.llm.scratch import Scratch
from atomsift.session import bounded_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the upper grade is at least one half."""
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return quality.select(docs, model, least=1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group with 0.8 of its five-word shingles in common."""
    bounded_batches(spark)
    return ngram_join.drop_similar(docs, Scratch(spark, "near-copies"), words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    bounded_batches(spark)
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")
    return pii.redact_documents(docs).withColumn("n_chars", length)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal data", redact),
    ("packing", pack),
]

#: The learned classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written once and read back."""
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, tables.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
