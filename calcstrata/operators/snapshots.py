"""Snapshots, history and chains of commits, over many repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def compare(new: DataFrame, old: DataFrame, key: str | list[str] = "path") -> DataFrame:
    """Files that differ between two snapshots: change is added, deleted or modified; equal hashes are dropped here.

    Both sides have the key, blob_hash and any other columns, which come back
    as new_<name> and old_<name>.
    """
    keys = [key] if isinstance(key, str) else key
    sides = []
    for df, side in ((new, "new"), (old, "old")):
        sides.append(df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys), F.lit(True).alias(f"_{side}")))
    joined = sides[0].join(sides[1], keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(~F.col("new_blob_hash").eqNullSafe(F.col("old_blob_hash")), "modified")
    return joined.withColumn("change", change).where("change is not null").drop("_new", "_old")


def version_pairs(new: DataFrame, old: DataFrame, how: str = "inner") -> DataFrame:
    """(file, new_hash, old_hash) of files (path, blob_hash) whose contents differ: those that both sides have, or with a full outer join all."""
    side = lambda df, s: df.select(F.col("path").alias("file"), F.col("blob_hash").alias(f"{s}_hash"))
    return side(new, "new").join(side(old, "old"), "file", how).where("not new_hash <=> old_hash")


def overlay(parent: DataFrame, staged: DataFrame, key: str | list[str] = "path") -> DataFrame:
    """The parent's files, replaced and extended by the staged ones; nothing is ever deleted."""
    return parent.join(staged.select(*([key] if isinstance(key, str) else key)), key, "left_anti").unionByName(staged)


def chain_state(changes: DataFrame, chain: str, order: str, key: str, value: str) -> DataFrame:
    """The last value of each key of each chain, in one aggregate instead of a walk over commits."""
    return changes.groupBy(chain, key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), F.count(F.lit(1)).alias("n_changes"))


def states_along(changes: DataFrame, chain: str, order: str, key: str, value: str) -> DataFrame:
    """Each change with the value before it in its chain (null at first)."""
    return changes.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(chain, key).orderBy(order)))


def history(commits: DataFrame, limit: int | None = None, time: str = "timestamp", key: str = "commit_hash") -> DataFrame:
    """Newest first, ties by key; no limit for None and 0."""
    out = commits.orderBy(F.desc(time), F.asc(key))
    return out.limit(limit) if limit else out


def page_from(commits: DataFrame, start: object, limit: int | None = None, time: str = "timestamp", key: str = "commit_hash") -> DataFrame:
    """History from the commit ``start`` on, itself included; nothing if it is unknown."""
    at = commits.where(F.col(key) == start).agg(F.max(time).alias("_from"))
    return history(commits.join(F.broadcast(at), F.col(time) <= F.col("_from")).drop("_from"), limit, time, key)


def latest(commits: DataFrame, time: str = "timestamp", key: str = "commit_hash") -> DataFrame:
    """The newest commit of all."""
    rows = F.max_by(F.struct(*commits.columns), F.struct(time, key))
    return commits.agg(rows.alias("c")).where("c is not null").select("c.*")


def by_prefix(commits: DataFrame, prefix: str, key: str = "commit_hash") -> DataFrame:
    """Commits whose hash starts with the digits; a prefix that is no hex is an error."""
    if not prefix or any(c not in "0123456789abcdef" for c in prefix.lower()):
        raise ValueError(f"not a hash prefix: {prefix!r}")
    return commits.where(F.col(key).startswith(prefix.lower()))


#: Narrow sides of at most so many rows are broadcast.
BROADCAST_ROWS = 500_000


def resolve_prefixes(asked: DataFrame, commits: DataFrame, column: str = "prefix", key: str = "commit_hash") -> DataFrame:
    """(prefix, status, commit_hash) of a table of prefixes: ok with the one commit, ambiguous, unknown or malformed.

    Every hash is cut to the lengths that are asked for, which makes it an
    equi-join with map-side sums, whatever the number of prefixes and however
    many commits a short one has. Null and repeated prefixes: null is
    malformed, repeated ones give one row. A hash that several rows have is
    one commit.
    """
    prefixes = asked.select(F.col(column).cast("string").alias("prefix")).distinct()
    good = prefixes.where(F.col("prefix").rlike("^[0-9a-fA-F]{1,64}$")).select("prefix", F.lower("prefix").alias("_p"))
    told = good.groupBy(F.length("_p").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()  # at most 64 rows
    if not told:
        return prefixes.select("prefix", F.lit("malformed").alias("status"), F.lit(None).cast("string").alias("commit_hash"))
    cuts = F.array(*(F.substring(F.col(key), 1, r["n"]) for r in sorted(told, key=lambda r: r["n"])))
    each = commits.where(F.col(key).isNotNull()).select(F.col(key).alias("_h"), F.explode(F.array_distinct(cuts)).alias("_p"))
    wanted = good.select("_p").distinct()
    few = sum(r["rows"] for r in told) <= BROADCAST_ROWS
    each = each.join(F.broadcast(wanted) if few else wanted, "_p", "left_semi")
    found = each.groupBy("_p").agg(F.min("_h").alias("least"), F.max("_h").alias("most"))
    status = F.when(F.col("_p").isNull(), "malformed").when(F.col("least").isNull(), "unknown").when(F.col("least") == F.col("most"), "ok").otherwise("ambiguous")
    out = prefixes.join(good, "prefix", "left").join(found, "_p", "left")
    return out.select("prefix", status.alias("status"), F.when(status == "ok", F.col("least")).alias("commit_hash"))


def write_index(commits: DataFrame, path: str, key: str = "commit_hash") -> None:
    """Commits sorted by hash over files with separate ranges, so that a prefix reads the few row groups that can hold it."""
    n = max(1, int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    commits.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def segments(changes: DataFrame, commits: DataFrame, chain: str, order: str, path: str, every: int = 64) -> DataFrame:
    """What each file of each chain was, from when until when: the changes, and a full snapshot every ``every`` commits.

    changes: chain, order, path and any other columns; commits: chain, order
    (places from 0 on) of all commits. Gives chain, segment, path, the other
    columns, since and until (excluded). A file that stays the same has one
    row in each segment, which makes the segment's first state a full
    snapshot, so any commit is restored from its own segment alone. Of several
    changes of a file in one commit the last by the other columns counts.
    """
    rest = [c for c in changes.columns if c not in (chain, order, path)]
    once = changes.groupBy(chain, path, order).agg(F.max(F.struct(*rest)).alias("_v"))
    ends = commits.groupBy(chain).agg((F.max(order) + 1).alias("_end"))
    after = F.lead(order).over(Window.partitionBy(chain, path).orderBy(order))
    spans = once.withColumn("_next", after).join(ends, chain)
    spans = spans.select(chain, path, "_v", F.col(order).alias("_since"), F.coalesce("_next", "_end").alias("_until")).where("_since < _until")
    first, last = F.floor(F.col("_since") / every), F.floor((F.col("_until") - 1) / every)
    cut = spans.withColumn("segment", F.explode(F.sequence(first, last)))
    since, until = F.greatest("_since", F.col("segment") * every), F.least("_until", (F.col("segment") + 1) * every)
    return cut.select(chain, "segment", path, *(F.col(f"_v.{c}").alias(c) for c in rest), since.alias("since"), until.alias("until"))


def snapshot_at(table: DataFrame, commits: DataFrame, chain: str, order: str, every: int = 64) -> DataFrame:
    """The files of any number of commits (chain, order) at once, each from its own segment of ``segments``."""
    asked = commits.select(chain, order).distinct().withColumn("segment", F.floor(F.col(order) / every))
    joined = asked.join(table, [chain, "segment"]).where((F.col("since") <= F.col(order)) & (F.col(order) < F.col("until")))
    return joined.drop("segment", "since", "until")


def _cut(df: DataFrame) -> DataFrame:
    """The rows, without the plan that made them: checkpointed where the session names a folder, else kept in memory."""
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def ancestors(commits: DataFrame, key: list[str], parent: list[str], start: DataFrame) -> DataFrame:
    """(key.., depth): the start rows and all they descend from.

    Jump pointers are doubled, so a chain of n commits takes log2(n) joins,
    up to the chain's own end. A chain that comes back to itself is an error.
    """
    names = [f"a{i}" for i in range(len(key))]
    hop = commits.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), *(F.col(p).alias(n) for p, n in zip(parent, names, strict=True)))
    hop = _cut(hop.join(commits.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True))), names, "left_semi"))
    reached = start.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True))).withColumn("depth", F.lit(0).cast("bigint"))
    step, known = 1, hop.count()
    most = max(1, int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    while True:
        jumps = hop.select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)), *(F.col(n).alias(f"to_{n}") for n in names))
        further = reached.join(jumps, names).select(*(F.col(f"to_{n}").alias(n) for n in names), (F.col("depth") + step).alias("depth"))
        further = _cut(further)
        if further.isEmpty():
            break
        if step > known:  # a path of more steps than there are links meets a link twice
            raise ValueError("a commit is its own ancestor")
        reached = reached.unionByName(further).coalesce(most)  # the partitions of a union add up
        doubled = hop.join(jumps, names).select(*(F.col(f"k{i}") for i in range(len(key))), *(F.col(f"to_{n}").alias(n) for n in names))
        hop, step = _cut(doubled), step * 2
    return reached.select(*(F.col(n).alias(k) for n, k in zip(names, key, strict=True)), "depth")


def tracked_on_disk(tracked: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    """Tracked files with status staged (on disk) or skipped (missing)."""
    found = disk.select(key, F.lit(True).alias("_found")).dropDuplicates([key])
    return tracked.join(found, key, "left").withColumn("status", F.when(F.col("_found"), "staged").otherwise("skipped")).drop("_found")


def marked(staged: DataFrame, parent: DataFrame) -> DataFrame:
    """(path, mark, file_type, size) of staged files: A new, M changed, = as in the parent."""
    old = parent.select("path", F.col("blob_hash").alias("_old"))
    mark = F.when(F.col("_old").isNull(), "A").when(F.col("_old") != F.col("blob_hash"), "M").otherwise("=")
    return staged.join(old, "path", "left").select("path", mark.alias("mark"), "file_type", S.human_size(F.col("size_bytes")).alias("size"))


def one_line(commit_hash: Column, message: Column) -> Column:
    return F.concat_ws(" ", S.short_hash(commit_hash), S.first_line(message))
