"""Secret scan by corpus-wide ownership: who else holds the same value?

Patterns propose spans; the digest of each proposed value is counted over the
distinct repositories and owners of the whole corpus. A value that many owners
hold is a copied example; one that belongs to few owners and looks random is
taken for a live credential. Only DataFrame expressions are used, and values
leave the text as SHA-256 digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Kind, pattern, group of the value, least characters of the value. Only the last kind is the method's own.
KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE = 3
#: A value that holds one of these, in lower case, is a placeholder.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "0000", "1234")


def looks_live(value: Column, length: int = 16, distinct: int = 8) -> Column:
    """Long, of many different characters, letters and digits mixed, and no placeholder."""
    out = (F.length(value) >= length) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= distinct)
    for word in PLACEHOLDERS:
        out = out & ~F.lower(value).contains(word)
    return out


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """gap, size, ok, live, digest of each match: the characters before it since the last one, its own, and what its value is like.

    Splitting and extracting see the same matches, so the gaps and sizes add
    up to positions in code points. Texts without a match cost one search.
    """
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("size"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    each = F.transform(
        F.filter(parts, lambda p: p["size"].isNotNull()),
        lambda p: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), (F.length(p["value"]) >= least).alias("ok"), looks_live(p["value"]).alias("live"), F.sha2(p["value"], 256).alias("digest")),
    )
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<gap:int,size:int,ok:boolean,live:boolean,digest:string>>"))


def _spans(seen: DataFrame) -> DataFrame:
    """(row, owner, repository, start, rank, end, live, digest): positions by running sums within a row, failing matches left out."""
    kinds = F.array(*(F.struct(F.lit(i).alias("rank"), F.col(f"m{i}").alias("hits")) for i in range(len(KINDS))))
    own = ["row", "owner", "repository"]
    each = seen.select(*own, F.explode(kinds).alias("k")).select(*own, "k.rank", F.posexplode("k.hits").alias("at", "hit")).select(*own, "rank", "at", "hit.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("at"))
    spans = each.withColumn("end", end).where("ok").withColumn("start", F.col("end") - F.col("size"))
    before = Window.partitionBy("row").orderBy("start", "rank", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("covered", F.max(F.when(F.col("rank") < BASE, F.col("end"))).over(before))
    return spans.where((F.col("rank") < BASE) | (F.coalesce("covered", F.lit(0)) < F.col("end"))).select(*own, "start", "rank", "end", "live", "digest")


def ownership(spans: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repositories): over all rows; each step combines on the map side, so a value that a third of all rows hold stays small."""
    once = spans.select("digest", "owner", "repository").distinct()
    by_owner = once.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def find_secrets(spark: SparkSession, docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 1) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied), one row for each row of ``docs``.

    Base spans (assign, access, hex) always stay. Spans of kind ``owned`` are
    added: runs of 20 or more token characters that no base span covers, that
    look random, and whose value at most ``most_owners`` owners hold. n_live
    counts spans of either sort with such a value; n_copied those whose value
    more owners hold. Positions are code points, ends exclusive.

    Null texts are empty; a null owner or repository counts as one of its own;
    repeated rows each give a row, and count once as a repository; texts
    without spans have an empty ``spans``; an empty table gives no rows; other
    columns are ignored. Rows of spans are spread by row and by digest; the
    counts are broadcast only if they are few, else the join is one that Spark
    may split.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select("doc_id", named(owner).alias("owner"), named(repository).alias("repository"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    seen = stored(spark, rows.select("row", "doc_id", "owner", "repository", *(_matches(F.col("text"), *k[1:]).alias(f"m{i}") for i, k in enumerate(KINDS))), "secret-matches")
    spans = stored(spark, _spans(seen), "secret-spans")
    owners = stored(spark, ownership(spans), "secret-owners")
    told = spans.join(small(owners, owners.count()), "digest", "left").withColumn("live", F.col("live") & (F.col("n_owners") <= most_owners))
    told = told.where((F.col("rank") < BASE) | F.col("live"))
    counts = [F.count_if(F.col("rank") == i).alias(f"n_{KINDS[i][0]}") for i in range(BASE)]
    found = told.groupBy("row").agg(*counts, F.count_if("live").alias("n_live"), F.count_if(F.col("n_owners") > most_owners).alias("n_copied"), F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("all"))
    name = F.array(*(F.lit(k[0]) for k in KINDS))
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))
    found = found.select("row", *(f"n_{k[0]}" for k in KINDS[:BASE]), "n_live", "n_copied", joined(F.filter("all", lambda s: s["rank"] < BASE)).alias("base"), joined(F.col("all")).alias("spans"))
    out = seen.select("row", "doc_id").join(found, "row", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", *(number(f"n_{k[0]}") for k in KINDS[:BASE]), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), number("n_live"), number("n_copied"))


def sql(most_owners: int = 1) -> str:
    """The same rows in DuckDB's dialect, for ``documents`` with owner ``source`` and repository ``doc_id``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT \"row\", doc_id, source, {i} AS rank, generate_subscripts(regexp_extract_all(body, {quoted(p)}, 0), 1) AS nth, unnest(string_split_regex(body, {quoted(p)})[:-2]) AS gap, unnest(regexp_extract_all(body, {quoted(p)}, 0)) AS whole, unnest(regexp_extract_all(body, {quoted(p)}, {group})) AS value, {least} AS least FROM d WHERE regexp_matches(body, {quoted(p)})" for i, (_, p, group, least) in enumerate(KINDS)
    )
    placeholders = " AND ".join(f"NOT contains(lower(value), '{w}')" for w in PLACEHOLDERS)
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS "row", doc_id, source, coalesce(text, '') AS body FROM documents),
m AS ({kinds}),
p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY "row", rank ORDER BY nth) AS stop FROM m),
s AS (SELECT "row", doc_id, source, rank, CAST(stop - length(whole) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, value,
  length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AND {placeholders} AS live
  FROM p WHERE length(value) >= least),
u AS (SELECT * FROM s WHERE rank < {BASE} OR NOT EXISTS (SELECT 1 FROM s b WHERE b."row" = s."row" AND b.rank < {BASE} AND b.start <= s.start AND b.stop >= s.stop)),
o AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM u GROUP BY value),
t AS (SELECT u.*, n_owners, live AND n_owners <= {most_owners} AS mine FROM u JOIN o USING (value)),
g AS (SELECT "row", count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (mine) AS n_live, count(*) FILTER (n_owners > {most_owners}) AS n_copied,
  string_agg({names}[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {BASE}) AS base,
  string_agg({names}[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM t WHERE rank < {BASE} OR mine GROUP BY "row")
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING ("row")"""
