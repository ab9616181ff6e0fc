"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, dac, decontaminate, gif, hpylm, langid, ownership, packing, quality, simhash, suffixes, trie, urls
from .common import documents, importable


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, documents(spark, sf_dir))


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(spark, documents(spark, sf_dir))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(spark, documents(spark, sf_dir)).drop("frames")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(spark, documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_tokens(dac.write_tokens(spark, documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.find_secrets(spark, documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark, documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return trie.build_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_hpylm": op2_hpylm,
    "op3_packing": op3_packing,
    "op4_gif": op4_gif,
    "op5_urls": op5_urls,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffixes": op7_suffixes,
    "op8_dac": op8_dac,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
    "op11_ownership": op11_ownership,
    "op12_alignment": op12_alignment,
    "op13_trie": op13_trie,
}

ORACLE: dict[str, str] = {"op11_ownership": ownership.sql(), "op13_trie": trie.SQL}
