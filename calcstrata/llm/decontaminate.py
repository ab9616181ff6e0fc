"""Benchmark decontamination by templates: numbers, units and names become typed slots.

Documents and benchmark items are turned into the same word templates, and
windows of templates meet in a hash join. A passage that repeats an item with
other numbers, names or units keeps its template, so it is found; its slots
must then agree with the item's: a name stands for one name throughout, while
numbers, units and capitalised words that open a sentence are free to become
equal or different.
Windows of the words themselves meet in a second hash join, which finds what
templates cannot tell: items shorter than a window, items made of slots, and
text without blanks, where each character is a word.
Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored

END, NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002", "\ue003"
SLOTS = NUMBER + UNIT + NAME
#: Words that count as units after a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "v", "a", "j", "kj", "k", "pa", "bar", "ev", "eur", "usd", "gbp",
    "meter", "meters", "metre", "metres", "kilometers", "gram", "grams", "kilograms", "liter", "liters", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees",
)

#: Characters of scripts without blanks between words.
_ALONE = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"

_NUMBER = r"\d+(?:[.,]\d+)*"
_UNIT = "(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}\p{Ll}+"
#: A capitalised word after a lower-case letter, a comma or a semicolon opens no sentence.
_INSIDE = r"(?<=[\p{Ll},;] )"
_SPLIT = r"[^a-z0-9\p{L}\p{N}@]+"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, f"[{END}-{NAME}]", " ")


def _split(text: Column, markers: str = "") -> Column:
    return F.filter(F.split(text, _SPLIT.replace("@", markers)), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Words in lower case, and marked values, in order: as many as ``templates`` has.

    The value of a slot keeps its marker. A capitalised word that opens a
    sentence is marked as a number is, as it need not be a name.
    """
    out = F.regexp_replace(_bare(text), _NUMBER, f" {NUMBER}$0{END} ")
    out = F.regexp_replace(out, f"(?<={END} )( ?)({_UNIT})", f" {UNIT}$2{END} ")
    out = F.regexp_replace(out, f"(?<!{UNIT}){_INSIDE}{_NAME}", f" {NAME}$0{END} ")
    out = F.regexp_replace(out, f"(?<![{UNIT}{NAME}]){_NAME}", f" {NUMBER}$0{END} ")
    return F.regexp_extract_all(F.lower(out), F.lit(f"[{SLOTS}][^{END}]*{END}|[a-z0-9\\p{{L}}\\p{{N}}]+"), F.lit(0))


def templates(text: Column) -> Column:
    """The template of each token: a marker for a number, unit or capitalised word, else the word in lower case."""
    out = F.regexp_replace(_bare(text), _NUMBER, f" {NUMBER} ")
    out = F.regexp_replace(out, f"(?<={NUMBER} )( ?){_UNIT}", f" {UNIT} ")
    out = F.regexp_replace(out, _NAME, f" {NAME} ")
    return _split(F.lower(out), SLOTS)


def plain_words(text: Column) -> Column:
    """Words in lower case as they stand, slots or not; each character of a script without blanks is one."""
    return _split(F.regexp_replace(F.lower(text), _ALONE, " $0 "))


def window_hashes(words: Column, size: int) -> Column:
    """The hash of each window of ``size`` templates; [] for shorter texts.

    The word hashes are bound to a lambda's variable, so that they are
    computed once for a text and not again for each window.
    """

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - size
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(hashes, i + 1, size)))
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(each)

    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), windows), 1)


def _bound(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and computed columns, bound by a generator: a plain projection would be copied into each later use, and computed again for each window."""
    made = F.struct(*(c.alias(x) for x, c in columns.items()))
    return df.select(*keep, F.inline(F.array(made)).alias(*columns))


def _items(benchmark: DataFrame, size: int, plain: int) -> DataFrame:
    """Windows (item_id, at, hash, slots) of the items, with at least ``plain`` words that are no slots."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = _bound(rows, "item_id", words=templates(F.col("text")), raw=tokens(F.col("text")))
    rows = rows.select("item_id", "words", "raw", F.posexplode(window_hashes(F.col("words"), size)).alias("at", "hash"))
    slot = lambda w: w.isin(NUMBER, UNIT, NAME)
    own = F.slice("words", F.col("at") + 1, size)
    rows = rows.where(F.size(F.filter(own, lambda w: ~slot(w))) >= plain)
    return rows.select("item_id", "at", "hash", F.slice("raw", F.col("at") + 1, size).alias("item_raw"))


def _literal_items(benchmark: DataFrame, size: int) -> DataFrame:
    """Windows (item_id, size, at, hash) of the items' own words; an item shorter than ``size`` words is one window."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = _bound(rows, "item_id", words=plain_words(F.col("text"))).where(F.size("words") > 0)
    long = rows.where(F.size("words") >= size).select("item_id", F.lit(size).alias("size"), F.posexplode(window_hashes(F.col("words"), size)).alias("at", "hash"))
    short = rows.where(F.size("words") < size).select("item_id", F.size("words").alias("size"), F.lit(0).alias("at"), F.xxhash64(F.transform("words", lambda w: F.xxhash64(w))).alias("hash"))
    return long.unionByName(short)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 8, plain: int = 5, windows: int = 4, alone: int = 4, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, n_changed): documents that hold a benchmark passage, literal or with other slot values.

    A pair is reported if at least ``windows`` windows of the item (or all it
    has, if fewer) occur in the document, at one distance from each other, and
    each name of the item stands for one name in the document; numbers and
    units may take any values. n_changed counts slots with another value; 0: literal.
    A pair is reported as well if so many windows of the item's own words occur
    at one distance, whatever their slots; an item shorter than ``size`` words
    is one such window. Pairs found by this alone have n_slots and n_changed 0.
    An item of fewer than ``alone`` words is common speech inside of a longer
    text; it is found only in documents that hold nothing else.
    Null texts and ids never match, nor do items without a word; repeated rows
    give one row; rows of one doc_id with other texts are put together; other
    columns are ignored. The windows of the benchmark are broadcast only if
    there are at most ``broadcast_rows`` of them (about 100 bytes each), else
    shuffled.
    """
    found = _leaking_texts(spark, docs, benchmark, size, plain, windows, alone, broadcast_rows)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.coalesce(F.max("n_slots"), F.lit(0)).alias("n_slots"), F.coalesce(F.min("n_changed"), F.lit(0)).alias("n_changed"))


def _leaking_texts(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 8, plain: int = 5, windows: int = 4, alone: int = 4, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, copy, item_id, n_windows, n_slots, n_changed): as ``find_leaks``, each text (``copy``: its hash) by itself."""
    items = stored(spark, _items(benchmark, size, plain), "benchmark-windows")
    literal = stored(spark, _literal_items(benchmark, size), "benchmark-words")
    sizes = sorted({size, *(r["size"] for r in literal.select("size").distinct().collect())})
    n = items.count() + literal.count()
    per_item = items.groupBy("item_id").agg(F.countDistinct("at").alias("item_windows"))
    literal_per_item = literal.groupBy("item_id").agg(F.countDistinct("at").alias("item_windows"))
    keys = items.select("hash").unionByName(literal.select("hash")).distinct()
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text")).withColumn("copy", F.xxhash64("text"))
    own = F.transform(F.array(plain_words(F.col("text"))), lambda w: F.concat(*(window_hashes(w, k) for k in sizes)))
    # outer generators: from others Spark infers a filter that computes the whole array once more, and below the join
    hashes = rows.select("doc_id", F.explode_outer(F.concat(window_hashes(templates(F.col("text")), size), F.element_at(own, 1))).alias("hash"))
    # documents with any window of an item: few, and one row each
    met = stored(spark, hashes.join(small(keys, n, broadcast_rows), "hash", "left_semi").select("doc_id").distinct(), "met")
    again = rows.join(small(met, met.count()), "doc_id", "left_semi")
    key = ["doc_id", "copy", "item_id", "shift"]
    found = again.select("doc_id", "copy", F.posexplode_outer(window_hashes(templates(F.col("text")), size)).alias("doc_at", "hash"))
    hits = found.join(small(items.select("item_id", "at", "hash"), n, broadcast_rows), "hash").select("doc_id", "copy", "item_id", (F.col("doc_at") - F.col("at")).alias("shift"), "at").distinct()
    hits = stored(spark, hits, "hits")
    runs = hits.groupBy(*key).agg(F.countDistinct("at").alias("n_windows"))
    runs = stored(spark, runs.join(per_item, "item_id").where(F.col("n_windows") >= F.least(F.lit(windows), F.col("item_windows"))).select(*key, "n_windows"), "runs")
    # the slots' values, once for each document that has a run
    told = runs.select("doc_id", "copy").distinct()
    values = again.join(small(told, told.count()), ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
    values = _bound(values, "doc_id", "copy", raw=tokens(F.col("text")))
    pairs = hits.join(runs.select(*key), key, "left_semi").join(items.select("item_id", "at", "item_raw"), ["item_id", "at"]).join(values, ["doc_id", "copy"])
    pairs = pairs.select(*key, F.explode(F.arrays_zip("item_raw", F.slice("raw", F.col("shift") + F.col("at") + 1, size).alias("doc_raw"))).alias("z")).select(*key, F.col("z.item_raw").alias("a"), F.col("z.doc_raw").alias("b"))
    pairs = pairs.where(F.substring("a", 1, 1).isin(NUMBER, UNIT, NAME)).distinct()
    uses = pairs.groupBy(*key, "a").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("a") != F.col("b")).cast("int")).alias("changed"))
    forward = uses.groupBy(*key).agg(F.max(F.when(F.substring("a", 1, 1) == NAME, F.col("n"))).alias("most"), F.count(F.lit(1)).alias("n_slots"), F.sum("changed").alias("n_changed"))
    told = runs.join(forward, key, "left").where(F.coalesce("most", F.lit(1)) == 1)
    told = told.select("doc_id", "copy", "item_id", "n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))
    return told.unionByName(_literal_runs(again, literal, literal_per_item, sizes, windows, alone, n, broadcast_rows), allowMissingColumns=True)


def _literal_runs(docs: DataFrame, items: DataFrame, per_item: DataFrame, sizes: list[int], windows: int, alone: int, n: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, copy, item_id, n_windows): enough windows of an item's own words at one distance from each other."""
    each = F.array(*(F.struct(F.lit(k).alias("size"), window_hashes(F.col("words"), k).alias("hashes")) for k in sizes))
    found = _bound(docs, "doc_id", "copy", words=plain_words(F.col("text"))).select("doc_id", "copy", F.size("words").alias("n_words"), F.explode_outer(each).alias("w"))
    found = found.where((F.col("w.size") >= alone) | (F.col("w.size") == F.col("n_words"))).select("doc_id", "copy", F.col("w.size").alias("size"), F.posexplode_outer("w.hashes").alias("doc_at", "hash"))
    hits = found.join(small(items, n, broadcast_rows), ["size", "hash"]).select("doc_id", "copy", "item_id", "at", (F.col("doc_at") - F.col("at")).alias("shift"))
    runs = hits.groupBy("doc_id", "copy", "item_id", "shift").agg(F.countDistinct("at").alias("n_windows"))
    return runs.join(per_item, "item_id").where(F.col("n_windows") >= F.least(F.lit(windows), F.col("item_windows"))).select("doc_id", "copy", "item_id", "n_windows")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage is found; all columns stay.

    Each row is judged by its own text, so other texts under the same doc_id
    stay; rows without doc_id or text stay; an empty benchmark takes nothing
    away, and an empty table gives an empty one.
    """
    leaks = stored(spark, _leaking_texts(spark, docs, benchmark).select("doc_id", "copy").distinct(), "leaks")
    own = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("copy"), own.alias("row"))
    return rows.join(small(leaks, leaks.count()), ["doc_id", "copy"], "left_anti").select("row.*")
