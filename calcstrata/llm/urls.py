"""URL filter: host and path rules, and boosted trees for the urls that no rule fits.

Everything on rows is a column expression. The labelled urls are those that a
rule decides. Their lexical features fall into few steps each, so all of them
collapse into at most ``lattice_size()`` cells with counts; that table is what
the driver boosts trees on. The trees go back into the plan as CASE
expressions. Suffix statistics use a fixed number of hash buckets.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, start of the path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Upper ends of the steps of each feature.
STEPS = {
    "length": (24, 32, 40, 50, 64, 90),
    "depth": (0, 1, 2, 3),
    "digit_ratio": (0.0, 0.06, 0.12, 0.2),
    "entropy": (2.4, 2.9, 3.3, 3.7),
    "hyphens": (0, 1),
    "params": (0, 1, 2),
    "suffix_rate": (0.1, 0.3, 0.5, 0.7, 0.9),
}
SUFFIX_BUCKETS = 1024


def lattice_size() -> int:
    return math.prod(len(x) + 1 for x in STEPS.values())


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: empty for null and for urls without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return _ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; nulls if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits for each character of a text."""
    n = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def suffix_bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIX_BUCKETS)).cast("int")


def suffix_rate(counts: list[tuple[int, int]], host: Column, told: Column) -> Column:
    """The share of ``block`` among the labelled urls of the suffix's bucket, (labelled, blocked) in ``counts``; a labelled url's own label is left out."""
    bucket = suffix_bucket(host) + 1
    n, y = (F.element_at(F.array(*(F.lit(c[i]).cast("bigint") for c in counts)), bucket) for i in (0, 1))
    own, block = told.isNotNull().cast("bigint"), F.coalesce((told == "block").cast("bigint"), F.lit(0).cast("bigint"))
    return (y - block + 1) / (n - own + 2)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return {
        "length": n,
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": F.when(n > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / n).otherwise(0.0),
        "entropy": _entropy(host),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
    }


def _step(value: Column, ends: tuple) -> Column:
    out = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        out = F.when(value <= ends[i], i).otherwise(out)
    return out.cast("int")


@dataclass
class Node:
    feature: str | None = None
    at: int = 0
    low: Node | None = None
    high: Node | None = None
    value: float = 0.0


def _grow(rows: list[tuple], depth: int, names: list[str], shrink: float, least: float) -> Node:
    """rows: (steps, gradient sum, hessian sum); the split with the best gain, or a leaf."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Node(value=shrink * g / (h + 1.0))
    if not depth:
        return leaf
    best, gain = None, 1e-6
    for k, name in enumerate(names):
        sums: dict[int, list[float]] = {}
        for steps, a, b in rows:
            s = sums.setdefault(steps[k], [0.0, 0.0])
            s[0] += a
            s[1] += b
        left_g = left_h = 0.0
        for step in sorted(sums)[:-1]:
            left_g += sums[step][0]
            left_h += sums[step][1]
            right_g, right_h = g - left_g, h - left_h
            if min(left_h, right_h) < least:
                continue
            got = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g**2 / (h + 1)
            if got > gain:
                best, gain = (k, name, step), got
    if best is None:
        return leaf
    k, name, step = best
    return Node(
        name,
        step,
        _grow([r for r in rows if r[0][k] <= step], depth - 1, names, shrink, least),
        _grow([r for r in rows if r[0][k] > step], depth - 1, names, shrink, least),
    )


def _value(node: Node, steps: dict[str, int]) -> float:
    while node.feature is not None:
        node = node.low if steps[node.feature] <= node.at else node.high
    return node.value


def boost(cells: list[tuple[tuple[int, ...], float, float]], names: list[str], trees: int = 24, depth: int = 3, shrink: float = 0.3, least: float = 1.0) -> tuple[float, list[Node]]:
    """Newton boosting of the logistic loss over (steps, rows, positive rows)."""
    total, positive = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not total:
        return 0.0, []
    rate = (positive + 0.5) / (total + 1)
    base = math.log(rate / (1 - rate))
    margins = [base] * len(cells)
    grown = []
    for _ in range(trees):
        rows = []
        for (steps, n, y), m in zip(cells, margins, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))
            rows.append((steps, y - n * p, n * p * (1 - p)))
        tree = _grow(rows, depth, names, shrink, least)
        grown.append(tree)
        for i, (steps, _, _) in enumerate(cells):
            margins[i] += _value(tree, dict(zip(names, steps, strict=True)))
    return base, grown


def tree_column(node: Node) -> Column:
    if node.feature is None:
        return F.lit(float(node.value))
    return F.when(F.col(f"_{node.feature}") <= node.at, tree_column(node.low)).otherwise(tree_column(node.high))


def judge(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row; score: the trees' probability of ``block``.

    The longest fitting rule decides, else the trees. Null urls and urls
    without ``://`` have empty host and path and are left to the trees;
    repeated rows come out once each; other columns are ignored; urls of any
    length are read whole; without a url that a rule fits, everything else is
    allowed (score 0.5).
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_told", verdict)
    labelled = rows.where("_told is not null")
    sums = labelled.groupBy(suffix_bucket(F.col("host")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_told") == "block").alias("y"))
    counts = [(0, 0)] * SUFFIX_BUCKETS
    for r in sums.collect():  # at most SUFFIX_BUCKETS rows
        counts[r["b"]] = (r["n"], r["y"])
    features = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    features["suffix_rate"] = suffix_rate(counts, F.col("host"), F.col("_told"))
    names = list(STEPS)
    stepped = {f"_{x}": _step(features[x], STEPS[x]) for x in names}
    cells = labelled.withColumns(stepped).groupBy(*stepped).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_told") == "block").alias("y"))
    lattice = [(tuple(r[f"_{x}"] for x in names), float(r["n"]), float(r["y"])) for r in cells.collect()]  # at most lattice_size() rows
    base, trees = boost(sorted(lattice), names)
    margin = F.lit(float(base))
    for tree in trees:
        margin = margin + tree_column(tree)
    scored = rows.withColumns(stepped).withColumn("score", 1 / (1 + F.exp(-margin)))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_told", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
