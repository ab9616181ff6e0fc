"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before kept, and is written as Parquet before the next one starts. Rows with a
null doc_id pass the filters that need an id; null texts count as empty; the
order of rows and extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calcstrata.llm import decontaminate, packing, quality, simhash, suffixes
from calcstrata.llm.common import documents, importable, small_batches, stored
from calcstrata.llm.queries import vocabulary


def ready(spark: SparkSession) -> None:
    """Before each stage: workers find the package, and batches of texts stay small."""
    importable(spark)
    small_batches(spark)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ready(spark)
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each near-duplicate group (five words, similarity 0.8)."""
    ready(spark)
    return simhash.keep_one(spark, docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a document of smaller id has."""
    ready(spark)
    return suffixes.without_repeats(spark, docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    ready(spark)
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    ready(spark)
    return packing.pack(spark, docs, vocabulary("word_bpe_49k.json"), cache_words=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("suffix-array dedup", no_repeated_passages),
    ("benchmark decontamination", no_benchmark),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the fingerprints' groups.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
