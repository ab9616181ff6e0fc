"""Commits, histories, staging and scalar functions over whole driver tables, each with SQL that must agree.

Orders stand for commits and their lineitems for the files of a commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import commits, diff, facts, files, render, snapshots, staging
from ..parsers import md, registry
from ..parsers.values import number_or_text
from . import generated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hash(c) -> F.Column:
    return S.sha256_hex(c.cast("string").cast("binary"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit: its lines are the files, the order before is the parent; every third records an environment."""
    line = F.struct(_hash(F.concat_ws("-", "l_partkey", "l_suppkey")).alias("blob_hash"), F.lit("TEXT").alias("file_type"), (F.col("l_returnflag") == "R").alias("is_reference"), F.concat(F.lit("f"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey", F.lit("-"), F.col("l_returnflag")).alias("path"), F.col("l_partkey").alias("size_bytes"))
    own = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(line).alias("files"))
    k = F.col("k")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("o_orderpriority").alias("message"))
    environment = F.when(k % 3 == 0, F.create_map(F.lit("python"), F.concat(F.lit("3."), (k % 4).cast("string")), F.lit("hostname"), F.when(k % 2 == 0, "").otherwise("here")))
    return o.join(own, "k").select("k", F.when(k % 5 > 0, _hash(k - 1)).alias("parent_hash"), "timestamp", F.lit("é@host").alias("author"), "message", environment.alias("environment"), "files")


def commit_hash(spark, sf_dir):
    """The hash of each commit's canonical record."""
    return commits.with_hash(_commits(spark, sf_dir)).select("k", "commit_hash")


def commit_audit(spark, sf_dir):
    """J8 over commits: some records were altered after they were hashed."""
    stored = commits.with_hash(_commits(spark, sf_dir))
    told = commits.audit(stored.withColumn("message", F.when(F.col("k") % 7 == 0, "altered").otherwise(F.col("message"))))
    return told.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def commit_files(spark, sf_dir):
    """The files of each commit."""
    rows = _commits(spark, sf_dir).withColumn("commit_hash", _hash(F.col("k")))
    return commits.snapshot_files(rows).select("commit_hash", "path", "blob_hash", "is_reference", "size_bytes")


def commit_exists(spark, sf_dir):
    """Full hashes only; prefixes and malformed ones are not there."""
    k = F.col("o_orderkey")
    known = _table(spark, sf_dir, "orders").where(k % 2 == 0).select(_hash(k).alias("commit_hash"))
    asked = _table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, F.substring(_hash(k), 1, 12)).otherwise(_hash(k)).alias("commit_hash"))
    return commits.existing(asked, known).select("o_orderkey", "commit_hash")


def environment_compare(spark, sf_dir):
    """Recorded against current environment; an empty or absent value matches anything."""
    rows = _commits(spark, sf_dir).select(_hash(F.col("k")).alias("commit_hash"), "environment")
    return commits.compare_environment(rows, {"hostname": "here", "python": "3.1"}).groupBy("name", "stored", "current", "matches").agg(F.count(F.lit(1)).alias("n"))


def output_summary(spark, sf_dir):
    """K8: what the outputs of each commit say."""
    kinds = ("OUTCAR", "ORCA_OUTPUT", "LAMMPS_LOG")
    out = None
    for kind in kinds:
        own = generated.generated(spark, sf_dir, kind).withColumn("blob_hash", F.concat(F.lit(kind), F.lit(":"), "blob_hash"))
        out = own if out is None else out.unionByName(own)
    owned = out.select(F.substring_index("blob_hash", ":", -1).alias("commit_hash"), "blob_hash", "file_type")
    return commits.output_summary(registry.facts_of(out, list(kinds)), owned).select("commit_hash", "total_energy", "is_converged", "ionic_steps", "warnings")


def history_default(spark, sf_dir):
    """The long form of a history."""
    c = _table(spark, sf_dir, "orders").select(_hash(F.col("o_orderkey")).alias("commit_hash"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("a@b").alias("author"), F.concat("o_orderpriority", F.lit("\nmore")).alias("message"))
    return render.history_text(c).select("commit_hash", "text")


def history_json(spark, sf_dir):
    """K13."""
    c = _table(spark, sf_dir, "orders").select(_hash(F.col("o_orderkey")).alias("commit_hash"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("message"))
    return render.as_json(c)


def _entries(spark, sf_dir) -> DataFrame:
    return generated.diff_generated(spark, sf_dir).withColumn("ord", F.lit(1000))


def render_default(spark, sf_dir):
    """The entries of each file as text."""
    return render.diff_lines(_entries(spark, sf_dir)).select("file", "text")


def render_detailed(spark, sf_dir):
    return render.diff_lines(_entries(spark, sf_dir), "detailed").select("file", "text")


def render_compact(spark, sf_dir):
    return render.diff_lines(_entries(spark, sf_dir), "compact").select("file", "text")


def status_marks(spark, sf_dir):
    """Staged files against the last snapshot."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), S.sha256_hex(F.col("text").cast("binary")).alias("blob_hash"), F.col("n_chars").alias("size_bytes"), F.lit("TEXT").alias("file_type"))
    old = docs.where("path % 4 <> 0").select("path", F.when(F.col("path") % 4 == 1, "other").otherwise(F.col("blob_hash")).alias("blob_hash"))
    return snapshots.marked(docs, old).select("path", "mark", "size")


def semantic_identity(spark, sf_dir):
    """files whose bytes differ though no entry does are marked cosmetic, equal files are left out."""
    k = F.col("k")
    base = generated.orders(spark, sf_dir)
    old = F.concat(F.lit("ENCUT = "), (k % 7).cast("string"), F.lit("\nPREC = Low\n"))
    new = F.when(k % 3 == 0, F.concat(F.lit("# same\n prec=Low ; encut = "), (k % 7).cast("string"))).when(k % 3 == 1, F.regexp_replace(old, "Low", "High")).otherwise(old)
    pairs = base.select(F.concat(k.cast("string"), F.lit("/INCAR")).alias("file"), F.lit("INCAR").alias("file_type"), old.alias("old_text"), new.alias("new_text"))
    digest = lambda s: S.sha256_hex(F.col(f"{s}_text").cast("binary")).alias(f"{s}_hash")
    pairs = pairs.select("*", digest("old"), digest("new"))
    side = lambda s: pairs.select(F.col("file").alias("path"), F.col(f"{s}_hash").alias("blob_hash"))
    changed = snapshots.compare(side("new"), side("old")).select("path", "change")
    return diff.mark_cosmetic(changed, diff.diff_pairs(pairs, ["INCAR"]))


def keyword_diff(spark, sf_dir):
    """Keywords of two input versions, one entry each."""
    pairs = generated.versions(spark, sf_dir, "ORCA_INPUT")
    return diff.diff_pairs(pairs, ["ORCA_INPUT"]).select("file", "ord", "path", "old_value", "new_value", "change_type", "significance")


def diff_orca_input(spark, sf_dir):
    """U5, 2.11: as ``keyword_diff``, with the type and whether a version could be parsed."""
    return keyword_diff(spark, sf_dir).withColumn("file_type", F.lit("ORCA_INPUT")).withColumn("parse_error", F.lit(False))


def staging_counters(spark, sf_dir):
    """A3: what adding every document would do to an index that has some of them."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.col("lang"), F.lit("/"), "doc_id").alias("path"), "doc_id")
    index = docs.where("doc_id % 4 = 0").select("path")
    return staging.staging_counts(staging.staging_plan(docs, index, S.ignored(F.col("path"), ["en/", "*9"])))


def staging_remove(spark, sf_dir):
    """The index after some paths were taken out."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return staging.unstaged(docs, _table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("path")))


def contained_paths(spark, sf_dir):
    """paths inside of a root; a sibling with the same beginning is outside."""
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""))
    host = "/" + "www.example.com"
    return _table(spark, sf_dir, "pages").select("page_id", staging.contained(path, host).alias("inside"))


def _logs(spark, sf_dir) -> DataFrame:
    """A thermo log of each user: one table for each event type, one row for each event in order of id."""
    e = _table(spark, sf_dir, "events").where("value is not null")
    row = F.struct("event_id", F.concat_ws(" ", "event_id", F.col("value").cast("string")).alias("line"))
    blocks = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    block = F.concat(F.lit("Step Temp\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\nLoop time of 1\n"))
    logs = blocks.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", block.alias("text")))).alias("b"))
    return logs.select(F.col("user_id").cast("string").alias("blob_hash"), F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"))


def thermo_last_row(spark, sf_dir):
    """A5: the last row of the last table of each user's log."""
    parsed = md.parse_log(_logs(spark, sf_dir))
    return parsed.groupBy(F.col("blob_hash").alias("log")).agg(F.max(F.when(F.col("path") == "final_step", F.col("num"))).alias("step"), F.max(F.when(F.col("path") == "final_temp", F.col("num"))).alias("temp"))


def run_steps(spark, sf_dir):
    """A4: steps of all tables of a log, last less first; only positive sums."""
    return md.parse_log(_logs(spark, sf_dir)).where("path = 'run_steps'").select(F.col("blob_hash").alias("log"), F.col("num").cast("bigint").alias("run_steps"))


def cross_rules(spark, sf_dir):
    """INCAR against POSCAR in a directory of each order."""
    # the other built-in rule sets are turned off, so that they need not run
    out = generated.validate_directories(spark, sf_dir, {"poscar-potcar": False}).where("rule = 'incar-poscar'")
    return out.groupBy("passed", "errors", "warnings").agg(F.count(F.lit(1)).alias("n"))


def validate_rules(spark, sf_dir):
    """Which files of all eight types pass, in one plan."""
    out = None
    for kind in generated.TEXTS:
        own = generated.generated(spark, sf_dir, kind).select(F.concat(F.lit(kind), F.lit("/"), "blob_hash").alias("file"), "file_type", F.concat(F.lit(kind), F.lit("/"), "blob_hash").alias("blob_hash"), "text")
        out = own if out is None else out.unionByName(own)
    return files.validate(out).groupBy("file_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_passed"))


def script_words(spark, sf_dir):
    """Comments, quotes and continued lines of a script, as words."""
    text = F.expr(r"""concat('run ', k, ' # not "this"\nprint "a # b" ', k % 3, '\nfix 1 all & \n  nve # x\nvariable t string \'it is\'\nprint "open ', k % 5, '\n')""")
    rows = generated.orders(spark, sf_dir).select("k", md.script_commands(text).alias("c"))
    return rows.select("k", F.array_join(F.transform("c", lambda w: F.array_join(w, "|")), "\n").alias("words"))


def numeric_words(spark, sf_dir):
    """Words as integers, numbers or text, and ``n*v`` lists."""
    k = F.col("o_orderkey")
    word = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".5"))).when(k % 5 == 2, "1D").when(k % 5 == 3, "-2e3").otherwise("NaN")
    many = F.concat((k % 4 + 1).cast("string"), F.lit("*0.5  -1 "), F.when(k % 3 == 0, "x").otherwise("2"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", number_or_text(word).alias("v"), S.expanded(many).alias("l"))
    return rows.select("o_orderkey", "v.kind", "v.num", F.size("l").alias("n"), F.aggregate("l", F.lit(0.0), lambda a, x: a + x).alias("total"))


def vector_norm(spark, sf_dir):
    """Length of a vector, rounded to six digits."""
    k = F.col("o_orderkey")
    v = F.array(F.col("o_totalprice"), (k % 7).cast("double"), F.when(k % 5 > 0, F.lit(-1.5)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", S.vector_norm(v).alias("norm"))


def energy_units(spark, sf_dir):
    """Electronvolts to Hartree."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.hartree(F.col("o_totalprice")), 6).alias("hartree"))


def utc_times(spark, sf_dir):
    """Times as ISO-8601 text in UTC."""
    return _table(spark, sf_dir, "events").select("event_id", S.utc_text(F.col("ts")).alias("mtime"))


def set_lookup(spark, sf_dir):
    """A map's value or a default, and well-formed hashes."""
    m = F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(2))
    h = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("+"), F.substring(_hash(F.col("o_orderkey")), 1, 63))).otherwise(_hash(F.col("o_orderkey")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", S.looked_up(m, F.col("o_orderpriority"), F.lit(9)).alias("rank"), S.is_hash(h).alias("well_formed"))


def file_summaries(spark, sf_dir):
    """Compared files that have entries, with their worst significance."""
    out = facts.summarize(generated.diff_outcar(spark, sf_dir), ["file"])
    return out.select("file", "total_changes", "critical", "has_critical_changes")


QUERIES = {
    f.__name__: f
    for f in (
        commit_hash, commit_audit, commit_files, commit_exists, environment_compare, output_summary, history_default, history_json, render_default, render_detailed, render_compact, status_marks, semantic_identity, keyword_diff, diff_orca_input,
        staging_counters, staging_remove, contained_paths, thermo_last_row, run_steps, cross_rules, validate_rules, script_words, numeric_words, vector_norm, energy_units, utc_times, set_lookup, file_summaries,
    )
}

_PATH = "'f' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag"
_KEY = "sha256(CAST(o_orderkey AS VARCHAR))"
_STAMP = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"
_RECORDS = f"""SELECT o_orderkey AS k, '{{"author":"é@host",' || CASE WHEN o_orderkey % 3 = 0 THEN '"environment":{{"hostname":"' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'here' END || '","python":"3.' || (o_orderkey % 4) || '"}},' ELSE '' END
|| '"files":[' || string_agg('{{"blob_hash":"' || sha256(l_partkey || '-' || l_suppkey) || '","file_type":"TEXT","is_reference":' || (l_returnflag = 'R') || ',"path":"' || {_PATH} || '","size_bytes":' || l_partkey || '}}', ',' ORDER BY {_PATH})
|| '],"message":"' || o_orderpriority || '","parent":' || CASE WHEN o_orderkey % 5 > 0 THEN '"' || sha256(CAST(o_orderkey - 1 AS VARCHAR)) || '"' ELSE 'null' END || ',"timestamp":"' || {_STAMP} || '"}}' AS j
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate"""
_DIFFS = generated.ORACLE["diff_generated"]
_LOGS = "SELECT user_id, event_type, event_id, value FROM events WHERE value IS NOT NULL"
_MARK = "CASE change_type WHEN 'added' THEN '+' WHEN 'deleted' THEN '-' ELSE '~' END"
_CHANGE = "': ' || CASE change_type WHEN 'added' THEN new_value WHEN 'deleted' THEN old_value ELSE old_value || ' -> ' || new_value END"
_TAG = "CASE significance WHEN 'critical' THEN '!! ' WHEN 'major' THEN '! ' ELSE '' END"
_VALIDATED = " UNION ALL ".join(f"SELECT '{kind}' AS file_type, passed FROM ({generated.ORACLE['validate_' + kind.lower()]})" for kind in generated.TEXTS)
_OUT_FACTS = " UNION ALL ".join(f"SELECT k, path, num, value FROM ({generated.facts_sql(kind)})" for kind in ("OUTCAR", "ORCA_OUTPUT", "LAMMPS_LOG"))
_QC_WORDS = "CASE WHEN {0} % 6 = 0 THEN [] ELSE ['B3LYP', 'DEF2-TZVP', 'OPT'] END"
_QC_SIMPLE = ", ".join(
    "{{'ord': {}, 'path': '{}', 'o': {}, 'n': {}, 's': '{}'}}".format(o, p, *(f"CASE WHEN {w.format(key)} THEN {v.format(key)} END" for key in ("k", "(k + 2)")), s)
    for o, p, v, w, s in (
        (1, "charge", "CAST({0} % 3 - 1 AS VARCHAR)", "{0} % 5 <> 0", "critical"), (2, "multiplicity", "CAST({0} % 3 AS VARCHAR)", "{0} % 5 <> 0", "critical"), (3, "coord_format", "CASE WHEN {0} % 10 = 7 THEN '\"xyzfile\"' ELSE '\"xyz\"' END", "{0} % 5 <> 0", "critical"),
        (4, "maxcore", "CAST({0} % 4000 + 1 AS VARCHAR)", "true", "major"), (5, "nprocs", "CAST({0} % 16 + 1 AS VARCHAR)", "true", "major"), (6, "coordinates", "'\"2 atom(s)\"'", "{0} % 5 <> 0 AND {0} % 10 <> 7", "critical"),
        (1000, "block.pal.nprocs", "CAST({0} % 16 + 1 AS VARCHAR)", "true", "major"), (1000, "block.scf.maxiter", "CAST({0} % 200 AS VARCHAR)", "true", "major"),
    )
)

ORACLE = {
    "commit_hash": f"SELECT k, sha256(j) AS commit_hash FROM ({_RECORDS})",
    "commit_audit": "SELECT o_orderkey % 7 <> 0 AS ok, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "commit_files": f"SELECT {_KEY} AS commit_hash, {_PATH} AS path, sha256(l_partkey || '-' || l_suppkey) AS blob_hash, l_returnflag = 'R' AS is_reference, l_partkey AS size_bytes FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "commit_exists": f"SELECT o_orderkey, {_KEY} AS commit_hash FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0",
    "environment_compare": """SELECT name, stored, current, stored = '' OR stored = current AS matches, count(*) AS n FROM (
  SELECT 'hostname' AS name, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'here' ELSE '' END AS stored, 'here' AS current FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'python', CASE WHEN o_orderkey % 3 = 0 THEN '3.' || (o_orderkey % 4) ELSE '' END, '3.1' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) GROUP BY ALL""",
    "output_summary": f"""SELECT CAST(k AS VARCHAR) AS commit_hash, max(num) FILTER (path IN ('final_energy', 'final_etotal')) AS total_energy, min(num) FILTER (path IN ('scf_converged', 'optimization_converged', 'completed')) = 1 AS is_converged,
CAST(max(num) FILTER (path IN ('run_steps', 'scf_cycles')) AS INTEGER) AS ionic_steps, max(value) FILTER (path = '$error') AS warnings FROM ({_OUT_FACTS}) GROUP BY k""",
    "history_default": f"SELECT {_KEY} AS commit_hash, 'commit ' || {_KEY} || chr(10) || 'Author: a@b' || chr(10) || 'Date:   ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || '    ' || o_orderpriority || chr(10) || '    more' AS text FROM orders",
    "history_json": f"""SELECT '{{"commit_hash":"' || {_KEY} || '","message":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}}' AS json FROM orders""",
    "render_default": f"SELECT file, string_agg({_MARK} || ' ' || {_TAG} || path || {_CHANGE}, chr(10) ORDER BY path) AS text FROM ({_DIFFS}) GROUP BY file",
    "render_detailed": f"SELECT file, string_agg({_MARK} || ' ' || path || {_CHANGE} || ' [' || significance || ']', chr(10) ORDER BY path) AS text FROM ({_DIFFS}) GROUP BY file",
    "render_compact": f"SELECT file, string_agg({_MARK} || path, ', ' ORDER BY path) AS text FROM ({_DIFFS}) GROUP BY file",
    "status_marks": "SELECT doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE '=' END AS mark, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0) ELSE printf('%.2f MB', n_chars / 1048576.0) END AS size FROM documents",
    "semantic_identity": "SELECT o_orderkey || '/INCAR' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'cosmetic' ELSE 'modified' END AS change FROM orders WHERE o_orderkey % 3 < 2",
    "keyword_diff": f"""WITH w AS (SELECT o_orderkey AS k, {_QC_WORDS.format("o_orderkey")} AS a, {_QC_WORDS.format("(o_orderkey + 2)")} AS b FROM orders),
e AS (SELECT k, -2 AS ord, unnest(list_filter(a, lambda x: NOT list_contains(b, x))) AS word FROM w UNION ALL SELECT k, -1, unnest(list_filter(b, lambda x: NOT list_contains(a, x))) FROM w),
f AS (SELECT k, unnest([{_QC_SIMPLE}]) AS f FROM (SELECT o_orderkey AS k FROM orders))
SELECT CAST(k AS VARCHAR) AS file, ord, 'keyword.' || word AS path, CASE WHEN ord = -2 THEN '"' || word || '"' END AS old_value, CASE WHEN ord = -1 THEN '"' || word || '"' END AS new_value, CASE WHEN ord = -2 THEN 'deleted' ELSE 'added' END AS change_type, 'critical' AS significance FROM e
UNION ALL SELECT CAST(k AS VARCHAR), f.ord, f.path, f.o, f.n, CASE WHEN f.path = 'coordinates' THEN 'modified' WHEN f.o IS NULL THEN 'added' WHEN f.n IS NULL THEN 'deleted' ELSE 'modified' END, f.s FROM f WHERE f.o IS DISTINCT FROM f.n""",
    "staging_counters": "SELECT CASE WHEN lang = 'en' OR lang || '/' || doc_id LIKE '%9' THEN 'ignored' WHEN lang IS NOT NULL AND doc_id % 4 = 0 THEN 'updated' ELSE 'added' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "staging_remove": "SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "contained_paths": "SELECT page_id, p = 'www.example.com' OR starts_with(p, 'www.example.com/') AS inside FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)",
    "thermo_last_row": f"SELECT CAST(user_id AS VARCHAR) AS log, CAST(arg_max(event_id, {{'a': event_type, 'b': event_id}}) AS DOUBLE) AS step, arg_max(value, {{'a': event_type, 'b': event_id}}) AS temp FROM ({_LOGS}) GROUP BY 1",
    "run_steps": f"SELECT CAST(user_id AS VARCHAR) AS log, CAST(sum(s) AS BIGINT) AS run_steps FROM (SELECT user_id, max(event_id) - min(event_id) AS s FROM ({_LOGS}) GROUP BY user_id, event_type) GROUP BY 1 HAVING sum(s) > 0",
    "cross_rules": f"SELECT passed, errors, warnings, count(*) AS n FROM ({generated.ORACLE['validate_directories']}) WHERE rule = 'incar-poscar' GROUP BY 1, 2, 3",
    "validate_rules": f"SELECT file_type, count(*) AS n, count(*) FILTER (passed) AS passed, bool_and(passed) AS all_passed FROM ({_VALIDATED}) GROUP BY 1",
    "script_words": "SELECT o_orderkey AS k, 'run|' || o_orderkey || chr(10) || 'print|a # b|' || (o_orderkey % 3) || chr(10) || 'fix|1|all|nve' || chr(10) || 'variable|t|string|it is' || chr(10) || 'print|\"open|' || (o_orderkey % 5) AS words FROM orders",
    "numeric_words": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'double' WHEN 3 THEN 'double' ELSE 'string' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey::DOUBLE WHEN 1 THEN o_orderkey + 0.5 WHEN 3 THEN -2000.0 END::DOUBLE AS num,
CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 4 + 3 AS INTEGER) END AS n, CASE WHEN o_orderkey % 3 > 0 THEN ((o_orderkey % 4 + 1) * 0.5 + 1)::DOUBLE END AS total FROM orders""",
    "vector_norm": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN round(sqrt(o_totalprice * o_totalprice + (o_orderkey % 7) * (o_orderkey % 7) + 2.25::DOUBLE), 6) END AS norm FROM orders",
    "energy_units": "SELECT o_orderkey, round(o_totalprice * (1.0::DOUBLE / 27.211386245988::DOUBLE), 6) AS hartree FROM orders",
    "utc_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS mtime FROM events",
    "set_lookup": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS rank, o_orderkey % 3 <> 0 AS well_formed FROM orders",
    "file_summaries": f"SELECT file, count(*) AS total_changes, count(*) FILTER (significance = 'critical') AS critical, bool_or(significance = 'critical') AS has_critical_changes FROM ({generated.ORACLE['diff_outcar']}) GROUP BY 1",
}
ORACLE["diff_orca_input"] = f"SELECT *, 'ORCA_INPUT' AS file_type, false AS parse_error FROM ({ORACLE['keyword_diff']})"
