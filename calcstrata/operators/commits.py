"""Commit records: canonical form, hash, flattening and audit, for any number of commits at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def canonical(df: DataFrame) -> Column:
    """JSON with sorted keys and no blanks, null parents kept, non-ASCII kept; empty sections left out.

    Fields are declared in alphabetical order, as JSON text follows the order
    of a struct.
    """
    file = lambda f: F.struct(*(f[k].alias(k) for k in ("blob_hash", "file_type", "is_reference", "path", "size_bytes")))
    files = F.transform(F.array_sort("files", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)), file)
    rest = [files.alias("files"), F.col("message"), F.col("parent_hash").alias("parent"), F.col("timestamp")]
    keep = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(F.col("author"), *rest), keep)
    if "environment" not in df.columns:
        return plain
    entries = F.map_from_entries(F.array_sort(F.map_entries("environment")))
    full = F.to_json(F.struct(F.col("author"), entries.alias("environment"), *rest), keep)
    return F.when(F.coalesce(F.size("environment"), F.lit(0)) > 0, full).otherwise(plain)


def with_hash(commits: DataFrame) -> DataFrame:
    return commits.withColumn("commit_hash", F.sha2(canonical(commits).cast("binary"), 256))


def audit(commits: DataFrame) -> DataFrame:
    """(commit_hash, actual_hash, ok): the hash recomputed from the record."""
    actual = F.sha2(canonical(commits).cast("binary"), 256)
    return commits.select("commit_hash", actual.alias("actual_hash"), (F.col("commit_hash") == actual).alias("ok"))


def snapshot_files(commits: DataFrame) -> DataFrame:
    return commits.select("commit_hash", F.explode("files").alias("f")).select("commit_hash", "f.path", "f.blob_hash", "f.file_type", "f.is_reference", "f.size_bytes")


def compare_environment(stored: DataFrame, current: dict[str, str]) -> DataFrame:
    """(commit_hash, name, stored, current, matches): an empty stored value matches anything."""
    now = F.create_map(*(F.lit(x) for kv in current.items() for x in kv))
    names = F.explode(F.array(*map(F.lit, current))).alias("name")
    rows = stored.select("commit_hash", "environment", names)
    was = F.coalesce(S.looked_up(F.col("environment"), F.col("name"), F.lit("")), F.lit(""))
    return rows.select("commit_hash", "name", was.alias("stored"), F.element_at(now, F.col("name")).alias("current"), ((was == "") | (was == F.element_at(now, F.col("name")))).alias("matches"))


OUTPUTS = ("OUTCAR", "ORCA_OUTPUT", "LAMMPS_LOG")


def existing(hashes: DataFrame, commits: DataFrame) -> DataFrame:
    """The well-formed full hashes that are commits."""
    return hashes.where(S.is_hash(F.col("commit_hash"))).join(commits.select("commit_hash"), "commit_hash", "left_semi")


def output_summary(facts: DataFrame, files: DataFrame) -> DataFrame:
    """One row a commit from parsed outputs: energy, convergence and problems.

    files: commit_hash, blob_hash, file_type. max_force stays null, as forces
    are in none of the facts.
    """
    rows = files.join(facts, ["blob_hash", "file_type"]).where(F.col("file_type").isin(*OUTPUTS))
    pick = lambda *paths: F.max(F.when(F.col("path").isin(*paths), F.col("num")))
    return rows.groupBy("commit_hash").agg(
        pick("final_energy", "final_etotal").alias("total_energy"),
        (F.min(F.when(F.col("path").isin("scf_converged", "optimization_converged", "completed"), F.col("num"))) == 1).alias("is_converged"),
        pick("run_steps", "scf_cycles").cast("int").alias("ionic_steps"),
        F.lit(None).cast("double").alias("max_force"),
        F.max(F.when(F.col("path") == "$error", F.col("value"))).alias("warnings"),
    )
