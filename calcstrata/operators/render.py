"""Text of histories, diffs and states, one string column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def diff_lines(diffs: DataFrame, style: str = "default") -> DataFrame:
    """(file, text) in order of entries; style: default, compact or detailed."""
    mark = F.when(F.col("change_type") == "added", "+").when(F.col("change_type") == "deleted", "-").otherwise("~")
    none = lambda c: F.coalesce(c, F.lit("-"))
    change = (
        F.when(F.col("change_type") == "added", F.concat(F.lit(": "), none(F.col("new_value"))))
        .when(F.col("change_type") == "deleted", F.concat(F.lit(": "), none(F.col("old_value"))))
        .otherwise(F.concat(F.lit(": "), none(F.col("old_value")), F.lit(" -> "), none(F.col("new_value"))))
    )
    if style == "compact":
        line = F.concat(mark, "path")
    elif style == "detailed":
        line = F.concat(mark, F.lit(" "), F.col("path"), change, F.lit(" ["), F.col("significance"), F.lit("]"))
    elif style == "default":
        tag = F.when(F.col("significance") == "critical", "!! ").when(F.col("significance") == "major", "! ").otherwise("")
        line = F.concat(mark, F.lit(" "), tag, F.col("path"), change)
    else:
        raise ValueError(f"unknown style {style!r}")
    rows = diffs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "path", line.alias("line")))).alias("l"))
    return rows.select("file", F.array_join(F.transform("l", lambda x: x["line"]), ", " if style == "compact" else "\n").alias("text"))


def history_text(commits: DataFrame, oneline: bool = False) -> DataFrame:
    """(timestamp, commit_hash, text)."""
    if oneline:
        text: Column = F.concat_ws(" ", S.short_hash(F.col("commit_hash")), S.first_line(F.col("message")))
    else:
        text = F.concat(F.lit("commit "), "commit_hash", F.lit("\nAuthor: "), F.coalesce("author", F.lit("")), F.lit("\nDate:   "), F.coalesce(S.show_time(F.col("timestamp")), "timestamp"), F.lit("\n\n    "), F.regexp_replace("message", "\n", "\n    "))
    return commits.select("timestamp", "commit_hash", text.alias("text"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
