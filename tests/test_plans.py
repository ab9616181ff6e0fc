"""Plans of queries over many files: what must not be broadcast, planned twice or left out of generated code."""

import os

import pytest

from calcstrata.operators import files
from calcstrata.parsers import registry
from calcstrata.plans import catalog, generated

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["diff_incar", "diff_lammps_input", "validate_lammps_data", "validate_directories"])
def test_no_side_of_files_is_broadcast(spark, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF))


def test_keys_are_dealt_out_to_all_cores(spark):
    assert generated.orders(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_values_of_facts_are_outside_of_lambdas(spark):
    """A filter over an array of values would evaluate every value without generated code."""
    df = registry.facts_of(generated.generated(spark, SF, "LAMMPS_LOG"), ["LAMMPS_LOG"])
    top = plan(df).split("Generate explode")[1]
    assert "filter(" not in top


def test_rule_sets_share_one_pass(spark):
    """Three rule sets read the directories once: one aggregate by directory, and one of what cannot be parsed."""
    assert plan(catalog.QUERIES["validate_directories"](spark, SF)).count("Exchange hashpartitioning(dir") == 2


def test_rules_that_cannot_be_planned_leave_the_others(spark):
    from pyspark.sql import functions as F

    broken = files.Validator("broken", 1, True, lambda: F.lit(True), lambda: [files.Rule("X", "error", F.col("no_such_column"), "x")])
    table = spark.createDataFrame([("a/POSCAR", "short"), ("a/INCAR", "ENCUT = 1")], "path string, text string")
    got = {r["rule"]: r for r in files.run_validators(table, chosen=[broken, *files.enabled_validators()]).collect()}
    assert set(got) == {"broken", "poscar-potcar", "incar-poscar"}
    assert not got["broken"]["passed"] and got["broken"]["message"].startswith("the validator failed")
    assert got["incar-poscar"]["warnings"] == ["POSCAR cannot be read, checks skipped"]


def test_facts_are_typed_once(spark):
    """Each field's text is typed after it has become a row; with the typing in every field this plan had 77,842 characters."""
    df = registry.facts_of(generated.generated(spark, SF, "LAMMPS_INPUT"), ["LAMMPS_INPUT"])
    assert len(plan(df)) < 40_000


def test_files_meet_the_rules_of_their_type(spark):
    """Rules of types that do not occur are not planned."""
    own = generated.generated(spark, SF, "LAMMPS_DATA").withColumnRenamed("blob_hash", "file").selectExpr("*", "file AS blob_hash")
    got = plan(files.validate(own, ["LAMMPS_DATA"]))
    assert "ENCUT must be positive" not in got and "there must be atoms" in got


def test_rules_of_all_types_at_once(spark):
    """A parse error silences the rules of its type; a type without rules passes; errors keep the rules' order."""
    rows = [("a", "INCAR", "garbage"), ("b", "INCAR", "ENCUT = -1\nNSW = -1"), ("c", "LAMMPS_DATA", "t\n\n0 atoms\n0 atom types\n0 -1 xlo xhi\n"), ("d", "POSCAR", "x"), ("e", "LAMMPS_INPUT", "run 1\nfix 1 all npt temp 1 2 3\n")]
    table = spark.createDataFrame([(f, t, f, x) for f, t, x in rows], "file string, file_type string, blob_hash string, text string")
    got = {r["file"]: r["errors"] for r in files.validate(table).collect()}
    assert got["a"] == ['cannot be parsed: "no tags"'] and got["b"] == ["ENCUT must be positive", "NSW must not be negative"] and got["d"] == []
    assert got["c"] == ["there must be atoms", "there must be atom types", "lx must be positive"] and got["e"] == ["units are missing", "pair_style is missing"]
    facts = {r["path"]: r["value"] for r in registry.facts_of(table, ["LAMMPS_INPUT"]).collect()}
    assert facts["fix_npt"] == '{"style":"npt","Tstart":1.0,"Tstop":2.0,"Tdamp":3.0,"press_style":null}'


@pytest.mark.parametrize("name", ["diff_generated", "render_default", "render_detailed", "render_compact"])
def test_no_side_of_compared_files_is_broadcast(spark, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF))
