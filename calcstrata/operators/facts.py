"""Semantic diff: facts of two versions joined on their key, classified and summed up.

A facts table has, besides its keys, ``path``, ``num`` (double, for numbers
and truth values) and ``value`` (JSON text). Values are equal if both have
equal numbers, else if their JSON is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(new_num: Column, old_num: Column, new_value: Column, old_value: Column) -> Column:
    both = new_num.isNotNull() & old_num.isNotNull()
    return F.when(both, new_num == old_num).otherwise(new_value.eqNullSafe(old_value))


def fact_diff(new: DataFrame, old: DataFrame, keys: list[str], tolerance: Column | None = None) -> DataFrame:
    """(keys, path, old_value, new_value, change_type) of facts that differ; null values count as absent.

    ``tolerance`` may use the columns ``path`` and the keys: numbers closer
    than it are noise.
    """
    on = [*keys, "path"]
    side = lambda df, s: df.where("value is not null").select(*on, *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in on))
    joined = side(new, "new").join(side(old, "old"), on, "full_outer")
    change = (
        F.when(F.col("old_value").isNull(), "added")
        .when(F.col("new_value").isNull(), "deleted")
        .when(~same(F.col("new_num"), F.col("old_num"), F.col("new_value"), F.col("old_value")), "modified")
    )
    out = joined.withColumn("change_type", change).where("change_type is not null")
    if tolerance is not None:
        noise = (F.col("change_type") == "modified") & F.coalesce(F.abs(F.col("new_num") - F.col("old_num")) < tolerance, F.lit(False))
        out = out.where(~noise)
    return out


def summarize(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by change type and significance for each key, zeros kept."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_changes"),
        *(n("change_type", v) for v in ("added", "deleted", "modified")),
        *(n("significance", v) for v in ("critical", "major", "minor")),
        F.bool_or(F.col("significance") == "critical").alias("has_critical_changes"),
    )


def top_entries(diffs: DataFrame, keys: list[str], order: list[Column], most: int = 3) -> DataFrame:
    """The first entries of each key, with how many more there are."""
    ranked = diffs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return ranked.withColumn("more", F.greatest(total - most, F.lit(0))).where(F.col("rank") <= most)


def keyword_changes(new: Column, old: Column) -> Column:
    """Array of (keyword, change_type): deleted ones sorted, then added ones sorted."""
    up = lambda a: F.array_distinct(F.transform(a, F.upper))
    gone, come = F.array_sort(F.array_except(up(old), up(new))), F.array_sort(F.array_except(up(new), up(old)))
    mark = lambda a, t: F.transform(a, lambda k: F.struct(k.alias("keyword"), F.lit(t).alias("change_type")))
    return F.concat(mark(gone, "deleted"), mark(come, "added"))
