"""What adding files does to a staging index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def staging_plan(found: DataFrame, index: DataFrame, ignored: Column | None = None) -> DataFrame:
    """``found`` (path, ..) with status: ignored, updated (already in the index) or added."""
    before = index.select("path", F.lit(True).alias("_before")).dropDuplicates(["path"])
    hit = F.lit(False) if ignored is None else ignored
    status = F.when(hit, "ignored").when(F.col("_before"), "updated").otherwise("added")
    return found.join(before, "path", "left").withColumn("status", status).drop("_before")


def staging_counts(plan: DataFrame) -> DataFrame:
    """(status, n)."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def contained(path: Column, root: str) -> Column:
    """Whether an absolute, normal path is the root or lies under it."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")


def unstaged(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index without the paths."""
    return index.join(paths.select("path"), "path", "left_anti")


def with_types(files: DataFrame) -> DataFrame:
    return files.withColumn("file_type", S.type_at_staging(F.col("path")))
