"""Logs of any size: line by line over many tasks, with the facts that a whole log would give.

A stretch of lines does not know the table that it starts in. It is summed up
as what it does to any state before it: its leading rows of one width, which
count if the table has that width, whether the table can still be open at its
end, and the state that the rest leads to whatever was before. Such summaries
can be put together in any grouping that keeps their order, so a log is
combined level by level from groups of a bounded number of summaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import md
from . import values as V

_SUMMARY = f"struct<width:int,first:array<string>,last:array<string>,open:boolean,known:{md._STATE}>"
#: Lines in a stretch, and summaries in a group.
STRETCH, GROUP = 10_000, 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _summary(width: Column, first: Column, last: Column, open_: Column, known: Column) -> Column:
    return F.struct(width.alias("width"), first.alias("first"), last.alias("last"), open_.alias("open"), known.alias("known")).cast(_SUMMARY)


def summarized(lines: Column) -> Column:
    """The summary of a stretch of lines (struct<head,cells,blank>)."""
    none, no, empty = F.lit(None), F.lit(False), md.empty_state()

    def move(s: Column, x: Column) -> Column:
        cells = x["cells"]
        row = md.all_numbers(cells) & (s["width"].isNull() | (s["width"] == F.size(cells)))
        closed = lambda known: _summary(s["width"], s["first"], s["last"], no, known)
        return (
            F.when(~s["open"], closed(md.next_state(s["known"], x)))
            .when(x["head"].isNotNull(), closed(md.next_state(empty, x)))
            .when(x["blank"], s)
            .when(row, _summary(F.size(cells), F.coalesce(s["first"], cells), cells, F.lit(True), empty))
            .otherwise(closed(empty))
        )

    return F.aggregate(lines, _summary(none, none, none, F.lit(True), empty), move)


def applied(s: Column, m: Column) -> Column:
    """The state after a stretch, from the state before it and the stretch's summary."""
    none, width = F.lit(None), m["width"]
    fits = F.coalesce(F.size(s["head"]) == width, F.lit(False)) & s["head"].isNotNull()
    step = md.step_of(m["last"], s["head"])
    run = s["run"] + F.coalesce(step - F.coalesce(s["step"], md.step_of(m["first"], s["head"])), F.lit(0.0))
    led = F.when(width.isNull(), s).when(fits, md._state(s["head"], step, m["last"], s["head"], run)).otherwise(md._state(none, none, s["row"], s["names"], s["run"]))
    k = m["known"]
    whole = lambda z: md._state(k["head"], k["step"], F.coalesce(k["row"], z["row"]), F.coalesce(k["names"], z["names"]), z["run"] + k["run"])
    return _let(led, lambda z: F.when(m["open"], z).otherwise(whole(z)))


def combined(a: Column, b: Column) -> Column:
    """The summary of two stretches, one after the other."""
    went_on = lambda last: _summary(a["width"], a["first"], last, b["open"], b["known"])
    return (
        F.when(~a["open"], _summary(a["width"], a["first"], a["last"], F.lit(False), applied(a["known"], b)))
        .when(b["width"].isNull(), went_on(a["last"]))
        .when(a["width"].isNull(), b)
        .when(a["width"] == b["width"], went_on(b["last"]))
        .otherwise(_summary(a["width"], a["first"], a["last"], F.lit(False), b["known"]))
    )


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines (blob_hash, block, local, line) of text files, which Spark cuts among tasks; the path stands for the hash.

    ``block`` is where a task's part of the file starts, and ``local`` orders
    the lines of one part.
    """
    part = F.struct(F.col("_metadata.file_path").alias("blob_hash"), F.col("_metadata.file_block_start").alias("block"))
    rows = spark.read.text(list(paths)).select(part.alias("p"), F.monotonically_increasing_id().alias("local"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return rows.select("p.blob_hash", "p.block", "local", "line")


def parse_lines(lines: DataFrame, stretch: int = STRETCH, group: int = GROUP, block_bytes: int = 128 << 20) -> DataFrame:
    """Facts of logs from lines (blob_hash, block, local, line), the same as ``md.parse_log`` gives of their texts.

    Lines of a log are ordered by block and local. No group holds more than
    ``stretch`` lines or about ``group`` summaries. Single values, which count
    only where there is no table, are looked for inside stretches. A log
    without lines is not there.
    """
    order = [F.col("block"), F.col("local")]
    pieces = lines.groupBy("blob_hash", "block", F.floor(F.col("local") / stretch).alias("at")).agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("l"))
    pieces = V.computed(pieces.select("blob_hash", "block", "at", F.transform("l", lambda x: x["line"]).alias("l")), text=F.array_join("l", "\n"))
    tables = {"y": summarized(F.transform("l", md.yaml_line)), "c": summarized(F.transform("l", md.column_line))}
    pieces = V.computed(pieces, **tables, **md.single_values(F.col("text"))).drop("l", "text")
    for place in (["block", F.floor(F.col("at") / group).alias("at")], ["block", F.lit(0).cast("bigint").alias("at")], [(F.floor(F.col("block") / (group * block_bytes))).alias("block"), F.lit(0).cast("bigint").alias("at")], [F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("at")]):
        pieces = _level(pieces, place)
    start = md.empty_state()
    states = V.computed(pieces, y0=applied(start, F.col("y")), c0=applied(start, F.col("c")))
    return md.log_facts(states.select("blob_hash", F.col("y0").alias("y"), F.col("c0").alias("c"), *md.LAST_VALUES, *md.FIRST_VALUES))


def _level(pieces: DataFrame, place: list) -> DataFrame:
    """Summaries of groups of neighbours."""
    at = F.struct("block", "at")
    told = lambda c: F.when(F.col(c).isNotNull(), at)
    singles = [F.max_by(c, told(c)).alias(c) for c in md.LAST_VALUES] + [F.min_by(c, told(c)).alias(c) for c in md.FIRST_VALUES]
    lists = pieces.groupBy("blob_hash", *place).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), F.col("at").alias("a"), "y", "c"))).alias("s"), *singles)
    rest = F.slice("s", 2, F.size("s"))
    own = lambda k: F.aggregate(F.transform(rest, lambda x: x[k]), F.col("s")[0][k], combined)
    return V.computed(lists, y=own("y"), c=own("c")).drop("s")
