"""Registered queries: each reference operator on the driver's tables, with the SQL that must agree.

The generic tables stand in for repositories: documents for files and their
contents, labels for tracked files, conversations for commit chains, events
for time series, orders for commit history, pages for text to be searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blobs, facts, snapshots
from . import generated, records, stores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents: some removed, some new, some edited, some only reformatted."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", "lang")
    old = docs.where(F.col("path") % 10 != 3)
    text = F.when(F.col("path") % 5 == 0, F.concat("text", F.lit(" edited"))).when(F.col("path") % 5 == 1, F.concat(F.lit("  "), "text")).otherwise(F.col("text"))
    lang = F.when(F.col("path") % 7 == 0, F.lit("xx")).otherwise(F.col("lang"))
    new = docs.where(F.col("path") % 10 != 7).select("path", text.alias("text"), lang.alias("lang"))
    return new, old


_VERSIONS_SQL = """
WITH old AS (SELECT doc_id AS path, text, lang FROM documents WHERE doc_id % 10 <> 3),
new AS (SELECT doc_id AS path,
  CASE WHEN doc_id % 5 = 0 THEN text || ' edited' WHEN doc_id % 5 = 1 THEN '  ' || text ELSE text END AS text,
  CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 7)
"""


def _plain(text):
    return F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\r]+", ""), r"[ \t\n\r]+", " ")


def snapshot_diff_status(spark, sf_dir):
    """J1 with the identity shortcuts: changed files, marked cosmetic if only white space differs."""
    sides = [df.select("path", S.sha256_hex(F.col("text").cast("binary")).alias("blob_hash"), S.sha256_hex(_plain(F.col("text")).cast("binary")).alias("plain")) for df in _versions(spark, sf_dir)]
    changed = snapshots.compare(*sides)
    kind = F.when((F.col("change") == "modified") & (F.col("new_plain") == F.col("old_plain")), "cosmetic").otherwise(F.col("change"))
    return changed.groupBy(kind.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _facts(df: DataFrame) -> DataFrame:
    lang = F.struct(F.lit("lang").alias("path"), F.lit(None).cast("double").alias("num"), F.col("lang").alias("value"))
    size = F.struct(F.lit("length").alias("path"), F.length("text").cast("double").alias("num"), F.length("text").cast("string").alias("value"))
    return df.select(F.col("path").alias("file"), F.explode(F.array(lang, size)).alias("f")).select("file", "f.*")


def _document_diff(spark, sf_dir) -> DataFrame:
    new, old = _versions(spark, sf_dir)
    diffs = facts.fact_diff(_facts(new), _facts(old), ["file"])
    return diffs.withColumn("significance", F.when(F.col("path") == "lang", "critical").otherwise("major"))


def fact_diff_summary(spark, sf_dir):
    """What changed between two snapshots, and how seriously."""
    return _document_diff(spark, sf_dir).groupBy("change_type", "significance").agg(F.count(F.lit(1)).alias("n"))


def fact_diff_by_file(spark, sf_dir):
    out = facts.summarize(_document_diff(spark, sf_dir), ["file"])
    return out.select("file", "total_changes", "added", "deleted", "modified", "critical", "major", "minor", "has_critical_changes")


_DIFF_SQL = (
    _VERSIONS_SQL
    + """, nf AS (SELECT path AS file, 'lang' AS path, lang AS value FROM new UNION ALL SELECT path, 'length', CAST(length(text) AS VARCHAR) FROM new),
of AS (SELECT path AS file, 'lang' AS path, lang AS value FROM old UNION ALL SELECT path, 'length', CAST(length(text) AS VARCHAR) FROM old),
d AS (SELECT coalesce(n.file, o.file) AS file, coalesce(n.path, o.path) AS path, o.value AS old_value, n.value AS new_value,
  CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'deleted' ELSE 'modified' END AS change_type,
  CASE WHEN coalesce(n.path, o.path) = 'lang' THEN 'critical' ELSE 'major' END AS significance
  FROM (SELECT * FROM nf WHERE value IS NOT NULL) n FULL OUTER JOIN (SELECT * FROM of WHERE value IS NOT NULL) o ON n.file = o.file AND n.path = o.path
  WHERE n.value IS DISTINCT FROM o.value)
"""
)


def top3_per_file(spark, sf_dir):
    """At most three entries a group of files, and how many more there are."""
    diffs = _document_diff(spark, sf_dir).withColumn("folder", F.col("file") % 50)
    out = facts.top_entries(diffs, ["folder"], [F.col("file"), F.col("path")])
    return out.select("folder", F.col("rank").cast("bigint").alias("rank"), "file", "path", "change_type", F.col("more").cast("bigint").alias("more"))


def blob_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return blobs.distinct_blobs(blobs.hashed(docs)).select("blob_hash", "size_bytes", "copies", "first_key")


def blob_integrity_audit(spark, sf_dir):
    """Some stored texts are damaged, some are gone."""
    docs = table(spark, sf_dir, "documents")
    expected = docs.select(F.col("doc_id").alias("path"), S.sha256_hex(F.col("text").cast("binary")).alias("blob_hash"))
    stored = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = docs.where(F.col("doc_id") % 13 != 0).select(F.col("doc_id").alias("path"), S.sha256_hex(stored.cast("binary")).alias("actual_hash"))
    return blobs.audit(expected, found).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def blob_exists(spark, sf_dir):
    """Malformed hashes are not there, and no error."""
    docs = table(spark, sf_dir, "documents")
    have = docs.where(F.col("doc_id") % 2 == 0).select(S.sha256_hex(F.col("text").cast("binary")).alias("blob_hash"))
    asked = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("nothex")).otherwise(S.sha256_hex(F.col("text").cast("binary"))).alias("blob_hash"))
    return blobs.existing(asked, have.distinct()).select("doc_id", "blob_hash")


def blob_paths(spark, sf_dir):
    """Shard paths and short names."""
    h = S.sha256_hex(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", S.shard_path(h, ".gz").alias("shard"), S.short_hash(h).alias("short"), S.short_hash(h, 8).alias("blob_short"))


def prefix_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", S.sha256_hex(F.col("text").cast("binary")).alias("commit_hash"))
    return snapshots.by_prefix(docs, "0a").select("doc_id", "commit_hash")


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", S.sha256_hex(F.col("text").cast("binary")).alias("blob_hash"))


def snapshot_overlay(spark, sf_dir):
    """The state after turn 0, overlaid by the last later change of each role."""
    turns = _turns(spark, sf_dir)
    parent = turns.where("turn = 0").select("conv_id", F.col("role").alias("path"), "blob_hash").dropDuplicates(["conv_id", "path", "blob_hash"])
    staged = turns.where("turn > 0").groupBy("conv_id", F.col("role").alias("path")).agg(F.max_by("blob_hash", F.struct("turn", "blob_hash")).alias("blob_hash"))
    return snapshots.overlay(parent, staged, ["conv_id", "path"])


def chain_last_state(spark, sf_dir):
    changes = _turns(spark, sf_dir).groupBy("conv_id", "turn", "role").agg(F.max("blob_hash").alias("blob_hash"))
    return snapshots.chain_state(changes, "conv_id", "turn", "role", "blob_hash").select("conv_id", "role", "blob_hash", "turn", "n_changes")


def chain_steps(spark, sf_dir):
    """Every commit against the one before it, by role."""
    changes = _turns(spark, sf_dir).groupBy("conv_id", "turn", "role").agg(F.max("blob_hash").alias("blob_hash"))
    out = snapshots.states_along(changes, "conv_id", "turn", "role", "blob_hash")
    kind = F.when(F.col("previous_blob_hash").isNull(), "added").when(F.col("previous_blob_hash") != F.col("blob_hash"), "modified").otherwise("same")
    return out.select("conv_id", "turn", "role", kind.alias("change"))


def ancestry(spark, sf_dir):
    """M8: the last turn of each conversation and all its ancestors."""
    commits = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("parent", F.col("turn") - 1)
    heads = commits.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return snapshots.ancestors(commits, ["conv_id", "turn"], ["conv_id", "parent"], heads).select("conv_id", "turn", "depth")


def _commits(spark, sf_dir) -> DataFrame:
    when = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_hash"), when.alias("timestamp"), F.col("o_orderpriority").alias("message"))


def history_topn(spark, sf_dir):
    return snapshots.history(_commits(spark, sf_dir), 25)


def history_page(spark, sf_dir):
    commits = _commits(spark, sf_dir)
    return snapshots.page_from(commits, 100, 10)


def history_latest(spark, sf_dir):
    return snapshots.latest(_commits(spark, sf_dir)).select("commit_hash", "timestamp", "message")


def history_oneline(spark, sf_dir):
    """Short hash, first line and shown time."""
    c = _commits(spark, sf_dir).withColumn("commit_hash", S.sha256_hex(F.col("commit_hash").cast("string").cast("binary")))
    message = F.concat("message", F.lit("\nsecond line"))
    return c.select(snapshots.one_line(F.col("commit_hash"), message).alias("line"), S.show_time(F.col("timestamp")).alias("shown"))


def first_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.first_match(F.col("html"), "<title>([^<]*)</title>").alias("title"), S.first_match(F.col("html"), 'href="([^"]*)"').alias("href"))


def last_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.last_match(F.col("html"), 'href="([^"]*)"').alias("href"))


def json_facts(spark, sf_dir):
    """JSON into (key, number) facts."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("path", "value")).select("event_id", "path", S.as_number(F.col("value")).alias("num"))


_NAMES = ("INCAR", "a/kpoints", "b/CONTCAR", "POTCAR.Si", "POTCAR", "outcar", "water.inp", "water.out", "OUTCAR.OUT", "log.lammps", "run.log", "log.out", "data.inp", "data", "data.melt", "x.lmp", "in.melt", "melt.lammps", "lammps.in", "OSZICAR", "vasprun.xml", "notes.txt", "NOTES.TXT", "a.json", "deep/er/thing.bin", "README")


def _names(spark, sf_dir) -> DataFrame:
    """A path for every order: one of the names, in a folder of its own."""
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), k.cast("string"), F.lit("/"), name).alias("path"))


def type_detect_stage(spark, sf_dir):
    return _names(spark, sf_dir).select("path", S.type_at_staging(F.col("path")).alias("file_type"))


def type_detect_diff(spark, sf_dir):
    """The two detectors differ on purpose."""
    t = S.type_at_diff(F.col("path"))
    return _names(spark, sf_dir).select("path", t.alias("file_type"), S.can_parse(t).alias("parseable"))


def _type_sql(staging: bool) -> str:
    rows = f"""SELECT 'd' || o_orderkey || '/' || [{", ".join(f"'{n}'" for n in _NAMES)}][o_orderkey % {len(_NAMES)} + 1] AS path FROM orders"""
    md = """WHEN n LIKE 'LOG.%' OR n LIKE '%.LOG' THEN 'LAMMPS_LOG' WHEN n = 'DATA' OR n LIKE 'DATA.%' OR n LIKE '%.LMP' OR n LIKE '%.DATA' THEN 'LAMMPS_DATA'
      WHEN n LIKE 'IN.%' OR n LIKE '%.LAMMPS' OR n = 'LAMMPS.IN' THEN 'LAMMPS_INPUT'"""
    qc = "WHEN n LIKE '%.INP' THEN 'ORCA_INPUT' WHEN n LIKE '%.OUT' AND n <> 'OUTCAR.OUT' THEN 'ORCA_OUTPUT'"
    if staging:
        middle = f"WHEN n = 'POTCAR' THEN 'POTCAR' WHEN n = 'OUTCAR' THEN 'OUTCAR' WHEN n = 'VASPRUN.XML' THEN 'VASPRUN' WHEN n = 'OSZICAR' THEN 'OSZICAR' {md} {qc} WHEN b LIKE '%.json' THEN 'JSON' WHEN b LIKE '%.txt' THEN 'TEXT' ELSE 'UNKNOWN'"
    else:
        middle = f"WHEN n LIKE 'POTCAR%' THEN 'POTCAR' WHEN n = 'OUTCAR' THEN 'OUTCAR' {qc} {md}"
    case = f"CASE WHEN n = 'INCAR' THEN 'INCAR' WHEN n = 'KPOINTS' THEN 'KPOINTS' WHEN n IN ('POSCAR', 'CONTCAR') THEN 'POSCAR' {middle} END"
    base = f"SELECT path, {case} AS file_type FROM (SELECT path, upper(b) AS n, b FROM (SELECT path, string_split(path, '/')[-1] AS b FROM ({rows})))"
    if staging:
        return base
    kinds = ", ".join(f"'{x}'" for x in S.PARSED_TYPES)
    return f"SELECT path, file_type, coalesce(file_type IN ({kinds}), false) AS parseable FROM ({base})"


def ignore_filter(spark, sf_dir):
    """prefixes, names and whole paths."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("ignored", S.ignored(F.col("path"), ["m.", "blog.th/", "*.html", "*/fr/*", "www/"])).select("page_id", "ignored")


def size_render(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.human_size(F.col("n_chars") * (F.col("doc_id") % 900 + 1)).alias("size"))


def keyword_set_diff(spark, sf_dir):
    """Keywords gone and come between each turn of a conversation and the next that there is."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select("conv_id", "turn", words.alias("words"))
    pairs = turns.withColumn("before", F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return pairs.select("conv_id", "turn", F.explode(facts.keyword_changes(F.col("words"), F.col("before"))).alias("k")).select("conv_id", "turn", "k.keyword", "k.change_type")


def noise_filter(spark, sf_dir):
    """numbers closer than the tolerance are no change."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    fact = lambda num: o.select(F.col("o_orderkey").alias("file"), F.lit("price").alias("path"), num.alias("num"), num.cast("string").alias("value"))
    price, k = F.col("o_totalprice"), F.col("o_orderkey") % 4
    moved = F.when(k == 0, price).when(k == 1, price + 0.001).when(k == 2, price + 0.5).otherwise(price * 2)
    return facts.fact_diff(fact(moved), fact(price), ["file"], F.lit(0.01)).select("file", "path", "change_type")


def tracked_on_disk(spark, sf_dir):
    out = snapshots.tracked_on_disk(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")), table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path")))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_diff_status, fact_diff_summary, fact_diff_by_file, top3_per_file, blob_dedup, blob_integrity_audit, blob_exists, blob_paths, prefix_lookup, snapshot_overlay,
        chain_last_state, chain_steps, ancestry, history_topn, history_page, history_latest, history_oneline, first_match, last_match, json_facts,
        type_detect_stage, type_detect_diff, ignore_filter, size_render, keyword_set_diff, noise_filter, tracked_on_disk,
    )
} | generated.QUERIES | records.QUERIES | stores.QUERIES

_TURNS_SQL = "SELECT conv_id, turn, role, max(sha256(text)) AS blob_hash FROM conversations GROUP BY ALL"
_COMMITS_SQL = "SELECT o_orderkey AS commit_hash, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, o_orderpriority AS message FROM orders"

ORACLE = {
    "snapshot_diff_status": _VERSIONS_SQL
    + r""", p AS (SELECT n.path AS np, o.path AS op, n.text AS nt, o.text AS ot FROM new n FULL OUTER JOIN old o ON n.path = o.path)
SELECT CASE WHEN op IS NULL THEN 'added' WHEN np IS NULL THEN 'deleted'
  WHEN regexp_replace(regexp_replace(nt, '^[ \t\n\r]+', ''), '[ \t\n\r]+', ' ', 'g') = regexp_replace(regexp_replace(ot, '^[ \t\n\r]+', ''), '[ \t\n\r]+', ' ', 'g') THEN 'cosmetic' ELSE 'modified' END AS status, count(*) AS n
FROM p WHERE op IS NULL OR np IS NULL OR nt IS DISTINCT FROM ot GROUP BY 1""",
    "fact_diff_summary": _DIFF_SQL + "SELECT change_type, significance, count(*) AS n FROM d GROUP BY 1, 2",
    "fact_diff_by_file": _DIFF_SQL
    + """SELECT file, count(*) AS total_changes, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'deleted') AS deleted, count(*) FILTER (change_type = 'modified') AS modified,
count(*) FILTER (significance = 'critical') AS critical, count(*) FILTER (significance = 'major') AS major, count(*) FILTER (significance = 'minor') AS minor, bool_or(significance = 'critical') AS has_critical_changes FROM d GROUP BY file""",
    "top3_per_file": _DIFF_SQL
    + """, r AS (SELECT file % 50 AS folder, file, path, change_type, row_number() OVER (PARTITION BY file % 50 ORDER BY file, path) AS rank, count(*) OVER (PARTITION BY file % 50) AS total FROM d)
SELECT folder, rank, file, path, change_type, greatest(total - 3, 0) AS more FROM r WHERE rank <= 3""",
    "blob_dedup": "SELECT sha256(text) AS blob_hash, max(strlen(text)) AS size_bytes, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1",
    "blob_integrity_audit": "SELECT CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'mismatch' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "blob_exists": "SELECT doc_id, sha256(text) AS blob_hash FROM documents WHERE doc_id % 3 <> 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
    "blob_paths": "SELECT doc_id, substr(h, 1, 2) || '/' || substr(h, 3) || '.gz' AS shard, substr(h, 1, 7) AS short, substr(h, 1, 8) AS blob_short FROM (SELECT doc_id, sha256(text) AS h FROM documents)",
    "prefix_lookup": "SELECT doc_id, sha256(text) AS commit_hash FROM documents WHERE starts_with(sha256(text), '0a')",
    "snapshot_overlay": """WITH t AS (SELECT conv_id, turn, role AS path, sha256(text) AS blob_hash FROM conversations),
p AS (SELECT DISTINCT conv_id, path, blob_hash FROM t WHERE turn = 0),
s AS (SELECT conv_id, path, blob_hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, path ORDER BY turn DESC, blob_hash DESC) AS k FROM t WHERE turn > 0) WHERE k = 1)
SELECT * FROM s UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = p.conv_id AND s.path = p.path)""",
    "chain_last_state": f"SELECT conv_id, role, arg_max(blob_hash, turn) AS blob_hash, max(turn) AS turn, count(*) AS n_changes FROM ({_TURNS_SQL}) GROUP BY 1, 2",
    "chain_steps": f"""SELECT conv_id, turn, role, CASE WHEN p IS NULL THEN 'added' WHEN p <> blob_hash THEN 'modified' ELSE 'same' END AS change
FROM (SELECT *, lag(blob_hash) OVER (PARTITION BY conv_id, role ORDER BY turn) AS p FROM ({_TURNS_SQL}))""",
    "ancestry": """WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations),
a AS (SELECT conv_id, max(turn) AS turn, 0::BIGINT AS depth FROM c GROUP BY 1 UNION ALL SELECT c.conv_id, c.turn, a.depth + 1 FROM a JOIN c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1)
SELECT conv_id, turn, depth FROM a""",
    "history_topn": _COMMITS_SQL + " ORDER BY timestamp DESC, commit_hash LIMIT 25",
    "history_page": f"WITH c AS ({_COMMITS_SQL}) SELECT * FROM c WHERE timestamp <= (SELECT max(timestamp) FROM c WHERE commit_hash = 100) ORDER BY timestamp DESC, commit_hash LIMIT 10",
    "history_latest": f"SELECT * FROM ({_COMMITS_SQL}) ORDER BY timestamp DESC, commit_hash DESC LIMIT 1",
    "history_oneline": f"SELECT substr(sha256(CAST(commit_hash AS VARCHAR)), 1, 7) || ' ' || message AS line, replace(replace(timestamp, 'T', ' '), 'Z', '') AS shown FROM ({_COMMITS_SQL})",
    "first_match": """SELECT page_id, CASE WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, CASE WHEN regexp_matches(html, 'href="([^"]*)"') THEN regexp_extract(html, 'href="([^"]*)"', 1) END AS href FROM pages""",
    "last_match": """SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1)[-1] AS href FROM pages""",
    "json_facts": "SELECT event_id, k AS path, CAST(json_extract_string(props, '$.' || k) AS DOUBLE) AS num FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "type_detect_stage": _type_sql(True),
    "type_detect_diff": _type_sql(False),
    "ignore_filter": """SELECT page_id, starts_with(p, 'blog.th/') OR starts_with(p, 'www/') OR p = 'm.' OR string_split(p, '/')[-1] = 'm.' OR p LIKE '%.html' OR string_split(p, '/')[-1] LIKE '%.html' OR p LIKE '%/fr/%' AS ignored
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)""",
    "size_render": "SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.2f MB', s / 1048576.0) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 900 + 1) AS s FROM documents)",
    "keyword_set_diff": """WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(list_filter(string_split_regex(min(text), '[^A-Za-z]+'), lambda w: w <> ''), lambda w: upper(w))) AS ws FROM conversations GROUP BY 1, 2),
p AS (SELECT conv_id, turn, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS a, ws AS b FROM t)
SELECT conv_id, turn, unnest(list_filter(a, lambda w: NOT list_contains(b, w))) AS keyword, 'deleted' AS change_type FROM p WHERE a IS NOT NULL UNION ALL SELECT conv_id, turn, unnest(list_filter(b, lambda w: NOT list_contains(a, w))), 'added' FROM p WHERE a IS NOT NULL""",
    "noise_filter": "SELECT o_orderkey AS file, 'price' AS path, 'modified' AS change_type FROM orders WHERE (o_orderkey % 4 = 2) OR (o_orderkey % 4 = 3 AND abs(o_totalprice) >= 0.01)",
    "tracked_on_disk": "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) THEN 'staged' ELSE 'skipped' END AS status, count(*) AS n FROM labels GROUP BY 1",
} | generated.ORACLE | records.ORACLE | stores.ORACLE
