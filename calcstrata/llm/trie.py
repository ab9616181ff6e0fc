"""The prefix trie of conversations, by prefix doubling.

Turns get dense names; blocks of 2, 4, 8, ... turns are named by the pair of
names of their halves, one join round for each doubling. The first d turns are
the blocks of d's binary digits, so their names are composed digit by digit,
and a prefix is called by the smallest conversation that starts with it.
Prefixes of equal name and depth are one node.

No conversation and no node is gathered in one task: positions and sums along
a conversation are running sums over range partitions, sums over nodes combine
on the map side, and lists of ids are hashed as streams of bounded chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, parts, small, stored

_LOCAL = (1 << 33) - 1
SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _sorted(spark: SparkSession, df: DataFrame, order: list[Column], keep: list, name: str) -> DataFrame:
    """Rows stored in ``order``, dealt by its ranges, with their partition and their place in it."""
    dealt = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    table = stored(spark, dealt.select(*keep, F.monotonically_increasing_id().alias("gid")), name)
    out = table.select("*", F.shiftright("gid", 33).alias("pid"))
    out._stored_at = table._stored_at
    return out


def _running(ordered: DataFrame, group: str, **values: Column) -> DataFrame:
    """``ordered`` with sums of ``values`` over its group's rows so far, each included.

    Sums run within range partitions; a group that spans several gets what
    the partitions before hold of it. There are at most two such groups in
    each partition, so the broadcast is bounded by twice their number.
    """
    local = Window.partitionBy("pid", group).orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy(group, "pid").agg(*(F.sum(v).alias(k) for k, v in values.items()))
    before = totals.select(group, "pid", F.count(F.lit(1)).over(Window.partitionBy(group)).alias("_n"), *(F.sum(k).over(earlier).alias(f"_{k}") for k in values))
    sums = ordered.select(*ordered.columns, *(F.sum(v).over(local).alias(k) for k, v in values.items()))
    out = sums.join(F.broadcast(before.where("_n > 1").drop("_n")), [group, "pid"], "left")
    return out.select(*ordered.columns, *((F.col(k) + F.coalesce(F.col(f"_{k}"), F.lit(0))).alias(k) for k in values))


def _named(spark: SparkSession, rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``name``: equal keys share a number from 0 on, without gaps."""
    table = stored(spark, rows.select(*keys).distinct().withColumn("gid", F.monotonically_increasing_id()), "trie-names")
    names = table.select(*keys, F.shiftright("gid", 33).alias("pid"), F.col("gid").bitwiseAND(F.lit(_LOCAL)).alias("at"))
    counts = sorted((r["pid"], r["n"]) for r in names.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for pid, n in counts:
        offsets.append((pid, total))
        total += n
    names = names.join(F.broadcast(spark.createDataFrame(offsets, "pid bigint, first bigint")), "pid").select(*keys, (F.col("first") + F.col("at")).alias("name"))
    out = stored(spark, rows.join(small(names, total), keys).select(*keep, "name"), "trie-named")
    discard(spark, table)
    return out


def _turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(conv, at, name, points) of the conversations' own turns: place from 0 on, dense name of (role, text), code points."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    start = F.substring("text", 1, 32)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", start, "text"]
    ordered = rows.repartitionByRange(parts(spark), *order[:-1]).sortWithinPartitions(*order)
    # the digest stands for (role, text) from here on; the length parts the two
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    table = stored(spark, ordered.select("conv", F.unhex(digest).alias("digest"), F.length("text").cast("bigint").alias("points"), F.monotonically_increasing_id().alias("gid")), "trie-rows")
    placed = _running(table.select("*", F.shiftright("gid", 33).alias("pid")), "conv", at=F.lit(1)).withColumn("at", F.col("at") - 1)
    out = _named(spark, placed, ["digest"], ["conv", "at", "points"])
    discard(spark, table)
    return out


def _rebuilt(spark: SparkSession, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, at, name, points) of rebuilt conversations, and (conv, len) of all, turnless ones too.

    A conversation takes at most five turns from another; so the first turns
    of those that others take from are short arrays.
    """
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    base = F.col("conv") - F.col("conv") % 100
    first = own.where((F.col("conv") % 100 == 0) & (F.col("at") < 5)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "name", "points"))).alias("turns"))
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n_own")).select("conv", "n_own", head.alias("head"), base.alias("base"))
    none = F.array().cast("array<struct<at:bigint,name:bigint,points:bigint>>")
    convs = convs.join(first, "base", "left").select("conv", "n_own", "head", F.slice(F.coalesce("turns", none), 1, F.col("head")).alias("taken"))
    convs = stored(spark, convs.select("*", (F.size("taken") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))).cast("bigint").alias("len")), "trie-convs")
    taken = convs.select("conv", F.inline("taken"))
    kept = own.where(F.col("at") >= head).join(convs.select("conv", "head", F.size("taken").alias("n_taken")), "conv")
    kept = kept.select("conv", (F.col("at") - F.col("head") + F.col("n_taken")).alias("at"), "name", "points")
    turns = stored(spark, taken.select("conv", "at", "name", "points").unionByName(kept), "trie-turns")
    return turns, convs.select("conv", "len")


def _blocks(spark: SparkSession, turns: DataFrame, longest: int) -> DataFrame:
    """(conv, depth, before, block): the last block of each depth's binary digits, and the depth before it.

    Level k names the blocks of 2**k turns that start at a multiple of it; a
    block at an even place is the last of the depth at its end.
    """
    level, found, k = turns.select("conv", "at", "name"), [], 0
    while True:
        last = level.where("at % 2 = 0").select("conv", F.shiftleft(F.col("at") + 1, k).alias("depth"), F.shiftleft("at", k).alias("before"), F.col("name").alias("block"))
        found.append(last)
        k += 1
        if 1 << k > longest:
            break
        half = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = level.groupBy("conv", F.shiftright("at", 1).alias("place")).agg(half(0).alias("a"), half(1).alias("b")).where("b is not null")
        level = _named(spark, pairs.select("conv", F.col("place").alias("at"), "a", "b"), ["a", "b"], ["conv", "at"])
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _prefixes(spark: SparkSession, blocks: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, first) and (depth, first, n_convs): each prefix is called by its smallest conversation.

    Depths with one binary digit are blocks; those with p digits extend what
    the round before has named.
    """
    rows, groups, named = [], [], None
    for digits in range(1, longest.bit_length() + 1):
        own = blocks.where(F.bit_count("depth") == digits)
        if named is None:
            pairs = own.select("conv", "depth", F.lit(-1).cast("bigint").alias("pre"), "block")
        else:
            pairs = own.join(named.select("conv", F.col("depth").alias("before"), F.col("first").alias("pre")), ["conv", "before"]).select("conv", "depth", "pre", "block")
        pairs = stored(spark, pairs, "trie-pairs")
        key = ["depth", "pre", "block"]
        group = stored(spark, pairs.groupBy(*key).agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("n_convs")), "trie-groups")
        n = group.count()
        if not n:
            break
        named = stored(spark, pairs.join(small(group.drop("n_convs"), n), key).select("conv", "depth", "first"), "trie-prefixes")
        discard(spark, pairs)
        rows.append(named)
        groups.append(group.select("depth", "first", "n_convs"))
    out, nodes = rows[0], groups[0]
    for r, g in zip(rows[1:], groups[1:], strict=True):
        out, nodes = out.unionByName(r), nodes.unionByName(g)
    return out, nodes


CHUNK_IDS = 1000


def _digests(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """(first, depth, ends_sha256) of the conversations (first, depth, conv) that end in a node, in ascending order.

    Sorted ranges turn into texts of at most ``CHUNK_IDS`` ids, wherever a
    range is cut; a node's texts then go through one hash, one after the other.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "first", "conv", "ids"]
        node, ids = None, []
        for batch in batches:
            out = []
            for depth, first, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if node != (depth, first) or len(ids) == CHUNK_IDS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (depth, first), []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, ids[0], ",".join(map(str, ids)))], names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "first", "ends_sha256"]
        node, state = None, None
        for batch in batches:
            out = []
            for depth, first, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if node == (depth, first):
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (depth, first), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names)

    order = ["depth", "first", "conv"]
    texts = ends.select(*order).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).mapInArrow(chunks, "depth bigint, first bigint, conv bigint, ids string")
    return texts.repartition(parts(spark), "depth", "first").sortWithinPartitions(*order).mapInArrow(hashes, "depth bigint, first bigint, ends_sha256 string")


def build_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; see ``SCHEMA``.

    Turns are ordered by turn, null first, then by role and text; null roles
    and texts are empty. Conversation c starts with the first crc32(c) % 6
    turns of conversation c - c % 100 in place of its own. A node's conv_id is
    its smallest member; the root has depth 0 and all conversations. Rows
    without a conv_id are left out, repeated rows are turns of their own, an
    empty table gives no rows, and other columns are ignored.
    """
    turns, convs = _rebuilt(spark, _turns(spark, conversations))
    told = convs.agg(F.min("conv"), F.count(F.lit(1)), F.max("len")).first()
    root, n_convs, longest = told[0], told[1], told[2]
    if not n_convs:
        return spark.createDataFrame([], SCHEMA)
    ends = convs.where("len = 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("first"), "conv")
    if not longest:
        top = _digests(spark, ends).select(F.col("first").alias("conv_id"), "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n_convs).cast("bigint").alias("n_convs"), *(F.lit(x).cast("bigint").alias(c) for c, x in (("n_children", 0), ("n_leaves", 1), ("saved_tokens", 0))), "ends_sha256")
        return top
    prefixes, groups = _prefixes(spark, _blocks(spark, turns, longest), longest)
    node = ["depth", "first"]
    above = prefixes.select(F.col("conv").alias("first"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("parent"))
    last = turns.select(F.col("conv").alias("first"), (F.col("at") + 1).alias("depth"), "points")
    nodes = groups.join(last, node).join(above, node, "left").select(*node, "n_convs", F.coalesce("parent", F.lit(root)).alias("parent"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    nodes = stored(spark, nodes, "trie-nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("first")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(spark, nodes.join(children, node, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children")), "trie-counted")
    # each conversation adds up what it is the first of, from its end to its start: that is its share of every subtree on its way
    own = nodes.select(F.col("first").alias("conv"), "depth", "saved", (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    way = prefixes.join(own, ["conv", "depth"], "left").select("conv", "depth", "first", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    way = _sorted(spark, way, [F.col("conv"), F.col("depth").desc()], ["conv", "depth", "first", "saved", "leaf"], "trie-ways")
    shares = _running(way, "conv", all_saved=F.col("saved"), all_leaves=F.col("leaf"))
    sums = shares.groupBy(*node).agg(F.sum("all_leaves").alias("n_leaves"), F.sum("all_saved").alias("saved_tokens"))
    ends = ends.unionByName(convs.select("conv", F.col("len").alias("depth")).join(prefixes, ["conv", "depth"]).select("depth", "first", "conv"))
    digests = _digests(spark, ends)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    total = nodes.agg(F.count_if(F.col("depth") == 1), F.sum("saved"), F.count_if(F.col("n_children") == 0)).first()
    top = spark.createDataFrame([(0, root, n_convs, None, *total)], "depth bigint, first bigint, n_convs bigint, parent bigint, n_children bigint, saved_tokens bigint, n_leaves bigint")
    out = nodes.drop("saved").join(sums, node).unionByName(top).join(digests, node, "left")
    return out.select(F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


#: The same rows in DuckDB's dialect; whole prefixes are grouped as lists.
SQL = r"""
WITH codes AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, n, c - c % 100 AS b,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c), codes),
re AS (SELECT conv.c, o.p, o.role, o.text FROM conv JOIN own o ON o.c = conv.b AND o.p < conv.h
  UNION ALL SELECT o.c, o.p - conv.h + least(conv.h, coalesce(k.n, 0)), o.role, o.text FROM own o JOIN conv ON o.c = conv.c AND o.p >= conv.h LEFT JOIN conv k ON k.c = conv.b),
way AS (SELECT c, p + 1 AS d, length(text) AS points, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY p) AS k FROM re
  UNION ALL SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM conv),
lens AS (SELECT c, max(d) AS len FROM way GROUP BY c),
node AS (SELECT k, d, min(c) AS m, count(*) AS n, any_value(points) AS points FROM way GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
up AS (SELECT k, d, n, points, n_children, unnest(range(0, d + 1)) AS j FROM full_node),
sums AS (SELECT k[1:j] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * points) AS saved_tokens FROM up GROUP BY 1),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM way JOIN lens USING (c) WHERE d = len GROUP BY k)
SELECT f.m AS conv_id, f.d AS depth, a.m AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node f JOIN sums USING (k) LEFT JOIN ends USING (k) LEFT JOIN node a ON f.d > 0 AND a.k = f.k[1:f.d - 1]"""
