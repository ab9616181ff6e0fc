"""The semantic diff of files: parse, join facts, classify, order."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..parsers import registry, rules
from ..parsers.values import ERROR, quoted
from . import facts


def _prepared(parsed: DataFrame) -> DataFrame:
    """Facts as they are compared: sets sorted, undiffed paths gone, keywords one by one."""
    kind, path = F.col("file_type"), F.col("path")
    place = rules.order(kind, path)
    place = F.when(place.isNull() | path.startswith("block."), 1_000).otherwise(place)
    sorted_set = F.to_json(F.array_sort(F.from_json("value", "array<string>")))
    value = F.when(path.isin(*rules.SETS), sorted_set).otherwise(F.col("value"))
    entry = lambda p, v, o: F.struct(p.alias("path"), v.alias("value"), o.alias("ord"))
    words = F.transform(F.from_json("value", "array<string>"), lambda w: entry(F.concat(F.lit("keyword."), w), quoted(w), F.lit(0)))
    single = F.when((place > 0) | (path == ERROR), F.array(entry(path, value, place)))
    items = F.when((kind == "ORCA_INPUT") & (path == "keywords"), words).otherwise(single)
    return parsed.select("blob_hash", "file_type", "kind", "num", F.explode(items).alias("e")).select("blob_hash", "file_type", "kind", "num", "e.*")


def diff_pairs(pairs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Differences of file versions; see ``diff_sides``.

    pairs: file, file_type, old_hash, old_text, new_hash, new_text. Equal
    contents are dropped before parsing.
    """
    changed = pairs.where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    version = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_hash").alias("blob_hash"), F.col(f"{s}_text").alias("text"))
    sides = changed.select("file", "file_type", F.explode(F.array(version("new"), version("old"))).alias("v")).select("file", "file_type", "v.*").where("blob_hash is not null")
    return _compared(sides, sides.where("text is not null"), types)


def diff_sides(sides: DataFrame, texts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Differences of the versions of files: sides (file, file_type, side, blob_hash), texts (blob_hash, text).

    Gives file, file_type, ord, path, old_value, new_value (JSON text),
    change_type, significance, parse_error. Each content is fetched and parsed
    once, whatever number of files and sides have it. A version that cannot be
    parsed gives one row with parse_error, so it is reported and not taken for
    unchanged.
    """
    wanted = sides.select("blob_hash", "file_type").distinct()
    return _compared(sides, wanted.join(texts, "blob_hash"), types)


def _compared(sides: DataFrame, files: DataFrame, types: list[str] | None) -> DataFrame:
    """Both versions' facts meet in one aggregate by (file, path), which is the full outer join of the two sides without reading either twice."""
    parsed = _prepared(registry.facts_of(files, types))
    # by a merge: estimates through generators are far too low, so Spark would collect and broadcast a side of any size
    known = sides.select("file", "file_type", "side", "blob_hash").join(parsed.hint("merge"), ["blob_hash", "file_type"])
    of = lambda s: F.max(F.when(F.col("side") == s, F.struct("value", "num", "kind", "ord"))).alias(s)
    keys = ["file", "file_type"]
    wide = known.groupBy(*keys, "path").agg(of("new"), of("old"))
    kind, path = F.col("file_type"), F.col("path")
    new, old = F.col("new.value"), F.col("old.value")
    change = F.when(old.isNull(), "added").when(new.isNull(), "deleted").when(~facts.same(F.col("new.num"), F.col("old.num"), new, old), "modified")
    both_real = (F.col("new.kind") == "double") & (F.col("old.kind") == "double")
    noise = F.coalesce(both_real & (F.abs(F.col("new.num") - F.col("old.num")) < rules.tolerance(kind, path)), F.lit(False))
    failed = path == ERROR
    rows = wide.withColumn("change_type", F.when(failed, "modified").when(~noise, change)).where("change_type is not null")
    file = Window.partitionBy(*keys)
    rows = rows.withColumn("_failed", F.max(failed).over(file)).withColumn("_retyped", F.max((kind == "KPOINTS") & (path == "type")).over(file))
    # a version that cannot be parsed, or a change of the kind of grid, makes the rest incomparable
    rows = rows.where((failed | ~F.col("_failed")) & ((path == "type") | failed | ~F.col("_retyped")))
    always = kind == "KPOINTS"
    for k, paths in rules.ALWAYS_MODIFIED.items():
        always = always | ((kind == k) & path.isin(*paths))
    atoms = lambda v: F.when(v.isNotNull(), F.concat(F.lit('"'), F.coalesce(F.size(F.from_json(v, "array<string>")), F.lit(0)).cast("string"), F.lit(' atom(s)"')))
    shown = lambda v: F.when((kind == "ORCA_INPUT") & (path == "coordinates"), atoms(v)).otherwise(v)
    rank = F.when(failed, 0).when(path.startswith("keyword."), F.when(F.col("change_type") == "deleted", -2).otherwise(-1)).otherwise(F.coalesce("new.ord", "old.ord"))
    return rows.select(
        *keys,
        rank.alias("ord"),
        "path",
        shown(old).alias("old_value"),
        shown(new).alias("new_value"),
        F.when(always, "modified").otherwise(F.col("change_type")).alias("change_type"),
        F.when(failed, "critical").otherwise(rules.significance(kind, path)).alias("significance"),
        failed.alias("parse_error"),
    )


def mark_cosmetic(changed: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, change) where modified files of a parsed type without an entry are cosmetic."""
    told = entries.select(F.col("file").alias("path")).distinct().withColumn("_told", F.lit(True))
    cosmetic = (F.col("change") == "modified") & F.col("_told").isNull() & registry.can_parse(F.col("path"))
    return changed.join(told, "path", "left").select("path", F.when(cosmetic, "cosmetic").otherwise(F.col("change")).alias("change"))


def ordered(diffs: DataFrame) -> DataFrame:
    return diffs.orderBy("file", "ord", "path")


def unified(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(file, text): unified differences of file versions (file, old_text, new_text); an absent side is empty, equal texts give no row."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for file, old, new in zip(b["file"], b["old_text"], b["new_text"], strict=True):
                sides = (f"a/{file}" if old is not None else "/dev/null", f"b/{file}" if new is not None else "/dev/null")
                texts.append("\n".join(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), *sides, lineterm="", n=context)))
            yield pd.DataFrame({"file": b["file"], "text": texts})

    return pairs.select("file", "old_text", "new_text").mapInPandas(lines, "file string, text string").where("text <> ''")
