"""The blob store, prefix tables, segments of snapshots, logs over many tasks and plug-ins on the driver's tables, each with SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import diff, files, snapshots
from ..operators.validate import Rule
from ..parsers import logs, registry
from ..parsers import values as V
from ..plugins import CheckPlugin, Manager, ParserPlugin
from ..sources.blobstore import BlobStore
from ..sources.files import shared_dir
from ..sources.manifest import Manifest
from . import generated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(c: Column) -> Column:
    return S.sha256_hex(c.cast("binary"))


def _store(spark: SparkSession, sf_dir: str) -> BlobStore:
    """A new store of all texts of documents, long ones in gzip."""
    store = BlobStore(spark, f"{shared_dir(spark)}/blobs-{Manifest.folder()}")
    text = F.col("text").cast("binary")
    store.write(_table(spark, sf_dir, "documents").where("text is not null").select(_digest(F.col("text")).alias("blob_hash"), text.alias("content")), compress_from=4096)
    return store


def blob_lookup(spark, sf_dir):
    """The blobs of labelled documents from a sharded store, read back; unknown and malformed hashes are not there."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").where("text is not null").select("doc_id", "text")
    kinds = F.array(F.struct(F.lit("known").alias("kind"), _digest(F.col("text")).alias("blob_hash")), F.struct(F.lit("unknown").alias("kind"), _digest(F.concat("text", F.lit("?"))).alias("blob_hash")), F.struct(F.lit("malformed").alias("kind"), F.lit("nothex").alias("blob_hash")))
    asked = docs.select("doc_id", F.inline(kinds))
    found = _store(spark, sf_dir).find(asked.select("blob_hash")).select("blob_hash", "size_bytes", _digest(F.col("content")).alias("read_back"))
    out = asked.join(found, "blob_hash", "left")
    return out.select("doc_id", "kind", F.col("size_bytes").isNotNull().alias("found"), "size_bytes", (F.col("read_back") == F.col("blob_hash")).alias("whole"))


def blob_sizes(spark, sf_dir):
    """S3, K1: size and tier of every blob, and whether the packed ones are smaller as stored."""
    return _store(spark, sf_dir).sizes().select("blob_hash", "size_bytes", "codec", ((F.col("codec") == "none") & (F.col("stored_bytes") == F.col("size_bytes")) | (F.col("codec") == "gzip") & (F.col("stored_bytes") < F.col("size_bytes"))).alias("as_expected"))


def prefix_resolve(spark, sf_dir):
    """A table of prefixes against all commits at once, ambiguity told."""
    commits = _table(spark, sf_dir, "orders").select(_digest(F.col("o_orderkey").cast("string")).alias("commit_hash"))
    key = F.col("c_custkey")
    hashed = _digest(key.cast("string"))
    prefix = F.when(key % 7 == 0, F.concat(F.lit("x"), hashed.substr(1, 5))).when(key % 7 == 1, F.upper(hashed)).otherwise(hashed.substr(F.lit(1), (key % 12 + 1).cast("int")))
    return snapshots.resolve_prefixes(_table(spark, sf_dir, "customer").select(prefix.alias("prefix")), commits)


def _chains(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    turns = _table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and role is not null")
    return turns.select("conv_id", "turn", "role", _digest(F.coalesce("text", F.lit(""))).alias("blob_hash")), turns.select("conv_id", "turn").distinct()


def snapshot_at(spark, sf_dir):
    """The files of every commit of every chain, each restored from its own segment."""
    changes, commits = _chains(spark, sf_dir)
    table = snapshots.segments(changes, commits, "conv_id", "turn", "role", every=3)
    return snapshots.snapshot_at(table, commits, "conv_id", "turn", every=3).select("conv_id", "turn", "role", "blob_hash")


def snapshot_sizes(spark, sf_dir):
    """K2: rows that segments store for each chain."""
    changes, commits = _chains(spark, sf_dir)
    return snapshots.segments(changes, commits, "conv_id", "turn", "role", every=3).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_stored"))


def thermo_splits(spark, sf_dir):
    """P5, A4, A5: the log of each user as lines in short stretches; every second user's tables are YAML."""
    e = _table(spark, sf_dir, "events").where("value is not null")
    kinds = [r["event_type"] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of names
    block = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type"))
    yaml = F.col("user_id") % 2 == 0
    own = [F.col("user_id").cast("string").alias("blob_hash"), block.alias("block")]
    row = F.when(yaml, F.concat(F.lit("  - ["), "event_id", F.lit(", "), F.col("value").cast("string"), F.lit(", ]"))).otherwise(F.concat_ws(" ", "event_id", F.col("value").cast("string")))
    rows = e.select(*own, F.col("event_id").alias("local"), row.alias("line"))
    line = lambda at, text: F.struct(F.lit(at).cast("bigint").alias("local"), F.lit(text).alias("line"))
    ends = F.when(yaml, F.array(line(-2, "keywords: ['Step', 'Temp', ]"), line(-1, "data:"), line(2**40, "..."))).otherwise(F.array(line(-1, "Step Temp"), line(2**40, "Loop time of 1")))
    lines = rows.unionByName(e.select("user_id", "event_type").distinct().select(*own, F.inline(ends)))
    parsed = logs.parse_lines(lines, stretch=2000, group=8, block_bytes=1)
    pick = lambda p: F.max(F.when(F.col("path") == p, F.col("num")))
    return parsed.groupBy(F.col("blob_hash").alias("log")).agg(pick("final_step").alias("step"), pick("final_temp").alias("temp"), F.coalesce(pick("run_steps"), F.lit(0.0)).cast("bigint").alias("run_steps"))


def parent_versions(spark, sf_dir):
    """The version before of every staged file that has another one; files without a parent, and equal ones, are not compared."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), _digest(F.coalesce("text", F.lit(""))).alias("blob_hash"))
    labelled = _table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("path"), "quality").distinct()
    parent = docs.join(labelled, "path").select("path", F.when(F.col("quality") == 1, F.col("blob_hash")).otherwise(_digest(F.concat("blob_hash", F.lit("before")))).alias("blob_hash"))
    return snapshots.version_pairs(docs, parent)


def noise_by_type(spark, sf_dir):
    """numbers of each type that differ by less and by more than the type's tolerance."""
    k = F.col("k")
    moved = lambda base, less, more: F.concat(F.lit(base), F.when(k % 3 == 0, less).when(k % 3 == 1, more).otherwise(""))
    texts = {
        "OUTCAR": lambda x: F.concat(F.lit("free energy TOTEN = -10.25"), x, F.lit(" eV\n")),
        "ORCA_OUTPUT": lambda x: F.concat(F.lit("FINAL SINGLE POINT ENERGY -10.25"), x, F.lit("\nORCA TERMINATED NORMALLY\n")),
        "LAMMPS_LOG": lambda x: F.concat(F.lit("5 atoms\nTotEng -10.25"), x, F.lit("\n")),
        "LAMMPS_DATA": lambda x: F.concat(F.lit("title\n\n5 atoms\n0.0 10.25"), x, F.lit(" xlo xhi\n0 1 ylo yhi\n0 1 zlo zhi\n")),
    }
    less = {"OUTCAR": "0000001", "ORCA_OUTPUT": "000000001", "LAMMPS_LOG": "000000001", "LAMMPS_DATA": "0000001"}
    out = None
    for kind, text in texts.items():
        own = generated.orders(spark, sf_dir).select(F.concat(F.lit(kind), F.lit("/"), k.cast("string")).alias("file"), F.lit(kind).alias("file_type"), text(F.lit("")).alias("old_text"), text(moved("", less[kind], "0001")).alias("new_text"))
        out = own if out is None else out.unionByName(own)
    pairs = out.select("*", _digest(F.col("old_text")).alias("old_hash"), _digest(F.col("new_text")).alias("new_hash"))
    return diff.diff_pairs(pairs, list(texts)).select("file", "path", "old_value", "new_value", "significance")


class Props(ParserPlugin):
    """A type as a package might add it: lines of ``name: value``."""

    name = "PROPS"
    order = ("energy", "state", "note")
    critical, major = ("energy",), ("state",)
    tolerances = {"energy": 0.01}

    def names(self, path):
        return F.lower(path).endswith(".props")

    def parse(self, table):
        pairs = F.transform(F.filter(F.split("text", "\n"), lambda x: x.contains(": ")), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("path"), F.lit("word").alias("mode"), F.regexp_replace(x, "^[^:]*: ", "").alias("text")))
        return V.long_facts(V.computed(table, p=pairs), {}, F.when(F.size("p") == 0, "no properties"), more=F.col("p"))

    def rules(self, fact):
        return [Rule("props", "error", fact("energy")["num"] <= 0, "the energy must be positive")]


class _Point:
    """An entry point of a package."""

    name = "props"

    @staticmethod
    def load():
        return Props


def _props(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    text = lambda energy, state: F.when(k % 17 == 0, "nothing").otherwise(F.concat(F.lit("energy: "), energy.cast("string"), F.lit("\nstate: s"), (state % 3).cast("string"), F.lit("\nnote: n"), (state % 4).cast("string")))
    old = (k % 90 - 5).cast("double") + 0.5
    new = F.when(k % 5 == 0, old + 0.001).otherwise(old + 1)
    rows = generated.orders(spark, sf_dir).select(F.concat(k.cast("string"), F.lit("/run.props")).alias("file"), text(old, k).alias("old_text"), F.when(k % 17 == 1, "nothing").otherwise(text(new, k + k % 2)).alias("new_text"))
    return rows.select("*", registry.type_of(F.col("file")).alias("file_type"), _digest(F.col("old_text")).alias("old_hash"), _digest(F.col("new_text")).alias("new_hash"))


def plugin_type_diff(spark, sf_dir):
    """A type that a package adds is found by its name, parsed and compared with its own order, significance and tolerance."""
    manager = Manager()
    manager.discover(lambda: [_Point])
    try:
        out = diff.diff_pairs(_props(spark, sf_dir), ["PROPS"])
    finally:
        manager.unregister("PROPS")
    return out.select("file", "file_type", "ord", "path", "old_value", "new_value", "change_type", "significance")


def plugin_type_rules(spark, sf_dir):
    """Files of an added type against the rules that come with it."""
    manager = Manager()
    manager.discover(lambda: [_Point])
    try:
        out = files.validate(_props(spark, sf_dir).select("file", "file_type", F.col("old_hash").alias("blob_hash"), F.col("old_text").alias("text")), ["PROPS"])
    finally:
        manager.unregister("PROPS")
    return out.select("file", "passed", F.concat_ws("; ", "errors").alias("errors"))


class Moody(CheckPlugin):
    """A check that raises in some directories."""

    name, priority = "moody", 1

    def applies(self):
        return F.array_contains("names", "INCAR")

    def check(self, texts):
        n = int(texts["INCAR"].split("=")[1])
        if n % 7 == 1:
            return ["one too many"], []
        if n % 7 == 0:
            raise ValueError("nothing left")
        return [], [f"{n % 7} left"]


def validators_apart(spark, sf_dir):
    """A check that raises fails in the directories in which it does, and nowhere else."""
    table = generated.orders(spark, sf_dir).select(F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/INCAR")).alias("path"), F.concat(F.lit("N = "), (F.col("k") % 100).cast("string")).alias("text"))
    manager = Manager()
    manager.register(Moody())
    out = manager.run(table, isolate=True)
    return out.select("dir", "rule", "passed", "message", F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"))


QUERIES = {f.__name__: f for f in (blob_lookup, blob_sizes, prefix_resolve, snapshot_at, snapshot_sizes, parent_versions, thermo_splits, noise_by_type, plugin_type_diff, plugin_type_rules, validators_apart)}

_CHAINS = "SELECT conv_id, turn, role, max(sha256(coalesce(text, ''))) AS blob_hash FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL GROUP BY ALL"
_PROPS = """SELECT o_orderkey AS k, o_orderkey % 17 = 0 AS old_bad, o_orderkey % 17 IN (0, 1) AS new_bad, CAST(o_orderkey % 90 - 5 + 0.5 AS DOUBLE) AS e, o_orderkey % 5 = 0 AS noise, o_orderkey AS os, o_orderkey + o_orderkey % 2 AS ns FROM orders"""
ORACLE = {
    "blob_lookup": """WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, 'known' AS kind, true AS found, strlen(text) AS size_bytes, true AS whole FROM d UNION ALL SELECT doc_id, unnest(['unknown', 'malformed']), false, NULL, NULL FROM d""",
    "blob_sizes": "SELECT DISTINCT sha256(text) AS blob_hash, strlen(text) AS size_bytes, CASE WHEN strlen(text) >= 4096 THEN 'gzip' ELSE 'none' END AS codec, true AS as_expected FROM documents WHERE text IS NOT NULL",
    "prefix_resolve": """WITH c AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
a AS (SELECT DISTINCT CASE c_custkey % 7 WHEN 0 THEN 'x' || substr(h, 1, 5) WHEN 1 THEN upper(h) ELSE substr(h, 1, CAST(c_custkey % 12 + 1 AS INT)) END AS prefix FROM (SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer)),
n AS (SELECT DISTINCT length(prefix) AS len FROM a), s AS (SELECT substr(h, 1, len) AS p, count(*) AS n, min(h) AS h FROM c, n GROUP BY 1)
SELECT prefix, CASE WHEN starts_with(prefix, 'x') THEN 'malformed' WHEN s.n IS NULL THEN 'unknown' WHEN s.n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN s.n = 1 THEN s.h END AS commit_hash FROM a LEFT JOIN s ON s.p = lower(prefix)""",
    "snapshot_at": f"""WITH t AS ({_CHAINS}), c AS (SELECT DISTINCT conv_id, turn FROM t)
SELECT c.conv_id, c.turn, t.role, arg_max(t.blob_hash, t.turn) AS blob_hash FROM c JOIN t ON t.conv_id = c.conv_id AND t.turn <= c.turn GROUP BY 1, 2, 3""",
    "snapshot_sizes": f"""WITH t AS (SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn), max(turn) OVER (PARTITION BY conv_id) + 1) AS stop FROM ({_CHAINS}))
SELECT conv_id, CAST(sum((stop - 1) // 3 - turn // 3 + 1) AS BIGINT) AS n_stored FROM t GROUP BY 1""",
    "thermo_splits": """WITH e AS (SELECT user_id, event_type, event_id, value FROM events WHERE value IS NOT NULL)
SELECT CAST(user_id AS VARCHAR) AS log, CAST(arg_max(hi, event_type) AS DOUBLE) AS step, arg_max(v, event_type) AS temp, CAST(sum(hi - lo) AS BIGINT) AS run_steps
FROM (SELECT user_id, event_type, max(event_id) AS hi, min(event_id) AS lo, arg_max(value, event_id) AS v FROM e GROUP BY 1, 2) GROUP BY 1""",
    "parent_versions": """SELECT d.doc_id AS file, sha256(coalesce(text, '')) AS new_hash, sha256(sha256(coalesce(text, '')) || 'before') AS old_hash FROM documents d JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id WHERE quality = 0""",
    "noise_by_type": """WITH k AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 1)
SELECT 'OUTCAR/' || k AS file, 'final_energy' AS path, '-10.25' AS old_value, '-10.250001' AS new_value, 'critical' AS significance FROM k UNION ALL SELECT 'ORCA_OUTPUT/' || k, 'final_energy', '-10.25', '-10.250001', 'critical' FROM k
UNION ALL SELECT 'LAMMPS_LOG/' || k, 'final_etotal', '-10.25', '-10.250001', 'critical' FROM k UNION ALL SELECT 'LAMMPS_DATA/' || k, unnest(['lx', 'volume']), '10.25', '10.250001', 'critical' FROM k""",
    "plugin_type_diff": f"""WITH p AS ({_PROPS}), d AS (
  SELECT k, 1 AS ord, 'energy' AS path, CAST(e AS VARCHAR) AS o, CAST(e + 1 AS VARCHAR) AS n, 'critical' AS s FROM p WHERE NOT old_bad AND NOT new_bad AND NOT noise
  UNION ALL SELECT k, 2, 'state', '"s' || (os % 3) || '"', '"s' || (ns % 3) || '"', 'major' FROM p WHERE NOT old_bad AND NOT new_bad AND os % 3 <> ns % 3
  UNION ALL SELECT k, 3, 'note', '"n' || (os % 4) || '"', '"n' || (ns % 4) || '"', 'minor' FROM p WHERE NOT old_bad AND NOT new_bad AND os % 4 <> ns % 4
  UNION ALL SELECT k, 0, '$error', NULL, '"no properties"', 'critical' FROM p WHERE new_bad AND NOT old_bad)
SELECT k || '/run.props' AS file, 'PROPS' AS file_type, ord, path, o AS old_value, n AS new_value, 'modified' AS change_type, s AS significance FROM d""",
    "plugin_type_rules": f"""SELECT k || '/run.props' AS file, NOT old_bad AND e > 0 AS passed, CASE WHEN old_bad THEN 'cannot be parsed: "no properties"' WHEN e <= 0 THEN 'the energy must be positive' ELSE '' END AS errors FROM ({_PROPS})""",
    "validators_apart": """SELECT 'd' || k AS dir, 'moody' AS rule, r > 1 AS passed, CASE r WHEN 0 THEN 'the validator failed: ValueError: nothing left' WHEN 1 THEN '1 problem(s)' ELSE 'ok' END AS message,
CASE r WHEN 0 THEN 'ValueError: nothing left' WHEN 1 THEN 'one too many' ELSE '' END AS errors, CASE WHEN r > 1 THEN r || ' left' ELSE '' END AS warnings FROM (SELECT o_orderkey AS k, o_orderkey % 100 % 7 AS r FROM orders)""",
}
