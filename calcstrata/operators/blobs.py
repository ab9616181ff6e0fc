"""Content-addressed blobs: distinct bytes, existence, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def hashed(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds blob_hash and size_bytes of the content."""
    return files.withColumn("blob_hash", S.sha256_hex(F.col(content))).withColumn("size_bytes", F.octet_length(content).cast("bigint"))


def distinct_blobs(files: DataFrame, key: str = "path") -> DataFrame:
    """One row a distinct content: blob_hash, size_bytes, copies, first_key. Combines on the map side."""
    return files.groupBy("blob_hash").agg(F.max("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))


def existing(hashes: DataFrame, blobs: DataFrame, column: str = "blob_hash") -> DataFrame:
    """The well-formed hashes that the store has."""
    return hashes.where(S.is_hash(F.col(column))).join(blobs.select(F.col("blob_hash").alias(column)), column, "left_semi")


def audit(expected: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """status of each expected file: ok, mismatch or missing. found: key, actual_hash."""
    joined = expected.join(found, key, "left")
    status = F.when(F.col("actual_hash").isNull(), "missing").when(F.col("actual_hash") == F.col("blob_hash"), "ok").otherwise("mismatch")
    return joined.withColumn("status", status)


def recomputed(blobs: DataFrame) -> DataFrame:
    """Blobs whose bytes no longer have their hash."""
    return blobs.withColumn("actual_hash", S.sha256_hex(F.col("content"))).where(F.col("actual_hash") != F.col("blob_hash"))
