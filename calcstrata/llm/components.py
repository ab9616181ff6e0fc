"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least node that each node knows, itself included; combined on the map side."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _star(pairs: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the least node that it knows.

    ``least`` is a stored table with one row a node, so both sides of the join
    are plain exchanges, and a node of very high degree is split as a skewed
    join (its rows over several tasks, its one row of ``least`` to each).
    """
    joined = pairs.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` (u, v: long) with the least node that it reaches.

    Each round is written to the shared folder, so a round never depends on
    the memory of an executor, and the round before is deleted. Rounds grow
    with the logarithm of the nodes; more than ``most_rounds`` is an error,
    never a partial result. Null ends and self links are ignored; no
    edges give no rows.
    """
    flat = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    flat = stored(spark, flat, "edges")
    state = _state(flat)
    for _ in range(most_rounds):
        if not state[0]:
            break
        files = max(8, state[0] // 200_000)  # links are narrow rows: not a file for each partition of the shuffle
        for large in (True, False):
            pairs = _both(flat) if large else flat
            least = stored(spark, _least(pairs).coalesce(files), "least")
            new = stored(spark, _star(pairs, least, large).coalesce(files), "star")
            discard(spark, flat, least)
            flat = new
        before, state = state, _state(flat)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
