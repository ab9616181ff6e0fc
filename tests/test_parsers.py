"""Fixture texts against typed facts and differences."""

import json

import pytest
from pyspark.sql import functions as F

from calcstrata.functions import scalars as S
from calcstrata.operators import diff as D
from calcstrata.parsers import registry
from calcstrata.plans import texts


def parse(spark, kind, text):
    df = spark.createDataFrame([("h", kind, text)], "blob_hash string, file_type string, text string")
    return {r["path"]: json.loads(r["value"]) for r in registry.facts_of(df, [kind]).collect()}


def differ(spark, name, old, new):
    df = spark.createDataFrame([(name, old, new)], "file string, old_text string, new_text string")
    digest = lambda c: S.sha256_hex(F.col(c).cast("binary"))
    kind = S.type_at_diff(F.col("file"))
    df = df.select("file", kind.alias("file_type"), digest("old_text").alias("old_hash"), "old_text", digest("new_text").alias("new_hash"), "new_text")
    types = [r["file_type"] for r in df.select("file_type").collect()]
    return [(r["path"], r["old_value"], r["new_value"], r["change_type"], r["significance"]) for r in D.ordered(D.diff_pairs(df, types)).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ISMEAR = 0; SIGMA = 0.05; NSW = 100", {"ISMEAR": 0, "SIGMA": 0.05, "NSW": 100}),
        ("MAGMOM = 5.0 -5.0 5.0 -5.0", {"MAGMOM": [5.0, -5.0, 5.0, -5.0]}),
        ("encut = 520 # note\n! NSW = 3\nEDIFF = 1e-6", {"ENCUT": 520, "EDIFF": 1e-6}),
        ("SYSTEM = Fe bulk calculation\nLWAVE = .FALSE.\nLCHARG = T", {"SYSTEM": "Fe bulk calculation", "LWAVE": False, "LCHARG": True}),
        ("", {}),
    ],
)
def test_incar(spark, text, want):
    assert parse(spark, "INCAR", text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Automatic mesh\n0\nGamma\n4 4 4\n0.5 0.5 0.5", {"type": "automatic", "gamma_centered": True, "grid": [4, 4, 4], "shift": [0.5, 0.5, 0.5]}),
        ("Explicit\n2\nCartesian\n0 0 0 1\n0.5 0 0 3", {"type": "explicit", "num_kpoints": 2, "cartesian": True}),
        ("Too short\n0", {"$error": "too few lines"}),
        ("Test\n0\nGamma\nnot a number", {"$error": "the grid is not numeric"}),
    ],
)
def test_kpoints(spark, text, want):
    got = parse(spark, "KPOINTS", text)
    assert {k: got[k] for k in want} == want


def test_outcar_error(spark):
    assert "$error" in parse(spark, "OUTCAR", "") and "$error" in parse(spark, "OUTCAR", "garbage")


def test_script_rules(spark):
    got = parse(spark, "LAMMPS_INPUT", "units metal # x\npair_coeff * * a # c\npair_coeff 1 1 b\nrun 10\nrun &\n 20\nfix 1 all npt temp ${T} 300 0.1 iso 0 0 1\nminimize 1e-4 1e-6 100 1000\nprint \"a # b\"\nvariable b equal 1\nvariable a equal 2\nvariable b equal 3")
    assert got["run"] == 20 and got["pair_coeff"] == "* * a" and got["variable_names"] == ["b", "a"] and got["minimize_maxiter"] == 100
    assert got["fix_npt"] == {"style": "npt", "Tstart": "${T}", "Tstop": 300.0, "Tdamp": 0.1, "press_style": "iso", "Pstart": 0.0, "Pstop": 0.0, "Pdamp": 1.0}
    assert "$error" in parse(spark, "LAMMPS_INPUT", "# only a comment\n")


def test_data_rules(spark):
    text = "title\n\n2  atoms\n1 atom  types\n0 10 xlo xhi\n0 10 ylo yhi\n-5 5 zlo zhi\n\nMasses # real\n\n1 12.011 # C\n\nAtoms\n\n1 1 0 0 0\n"
    got = parse(spark, "LAMMPS_DATA", text)
    assert got["num_atoms"] == 2 and got["num_atom_types"] == 1 and got["volume"] == 1000.0 and got["masses"] == {"1": 12.011} and got["sections"] == ["Masses", "Atoms"]
    assert "$error" in parse(spark, "LAMMPS_DATA", "t\n\n1 atom types\n")


def test_log_rules(spark):
    positive = parse(spark, "LAMMPS_LOG", "Step Temp\n0 1.5\n10 2.5\nLoop\nStep Temp\n10 3\n40 4\n")
    assert positive["final_step"] == 40 and positive["final_temp"] == 4.0 and positive["run_steps"] == 40 and positive["completed"] is False
    yaml = parse(spark, "LAMMPS_LOG", "---\nkeywords: ['Step', 'Temp', 'TotEng', ]\ndata:\n  - [0, 1.0, -5.0, ]\n  - [100, 1.5, -6.5, ]\n...\nTotal wall time: 0:00:01\n")
    assert yaml["final_etotal"] == -6.5 and yaml["run_steps"] == 100 and yaml["wall_time"] == "0:00:01"
    alone = parse(spark, "LAMMPS_LOG", "TotEng -3.5\nTemp 2.0\n")
    assert alone["final_etotal"] == -3.5 and alone["final_temp"] == 2.0


def test_qc_input_directive_keeps_next_block(spark):
    got = parse(spark, "ORCA_INPUT", texts.PAIRS["run/water.inp"][0] + "$new_job\n! HF\n")
    assert got["nprocs"] == 4 and got["block.geom.maxiter"] == 50 and "HF" not in got["keywords"] and got["coord_format"] == "xyz"
    assert parse(spark, "ORCA_INPUT", "! HF\n* xyzfile 0 1 a.xyz\n")["xyzfile"] == "a.xyz"


def test_diff_fixtures(spark):
    assert differ(spark, "INCAR", *texts.PAIRS["run/INCAR"]) == [("ENCUT", "520", "600", "modified", "critical"), ("ISMEAR", "0", "1", "modified", "critical"), ("LWAVE", None, "false", "added", "major"), ("SIGMA", "0.05", "0.1", "modified", "critical")]
    assert differ(spark, "INCAR", *texts.PAIRS["cosmetic/INCAR"]) == []
    assert [(p, s) for p, *_, s in differ(spark, "in.melt", *texts.PAIRS["run/in.melt"])] == [("timestep", "critical"), ("run", "critical"), ("fix_nvt", "major"), ("thermo", "minor")]
    assert [p for p, *_ in differ(spark, "data.lj", *texts.PAIRS["run/data.lj"])] == ["num_atoms", "lx", "ly", "lz", "volume"]


def test_unparseable_version_is_reported(spark):
    assert differ(spark, "KPOINTS", *texts.PAIRS["short/KPOINTS"]) == [("$error", None, '"too few lines"', "modified", "critical")]
    assert differ(spark, "KPOINTS", *texts.PAIRS["retyped/KPOINTS"]) == [("type", '"automatic"', '"line"', "modified", "critical")]


def test_diff_mirrors(spark):
    old, new = texts.PAIRS["run/water.inp"]
    there, back = differ(spark, "a.inp", old, new), differ(spark, "a.inp", new, old)
    turn = {"added": "deleted", "deleted": "added", "modified": "modified"}
    assert sorted(map(str, there)) == sorted(str((p, n, o, turn[c], s)) for p, o, n, c, s in back)


def test_validators(spark):
    from calcstrata.operators import files

    df = spark.createDataFrame(texts.DIRECTORIES, "path string, text string")
    got = {(r["dir"], r["rule"]): (r["passed"], len(r["errors"]), len(r["warnings"])) for r in files.run_validators(df, {"file-format": True}).collect()}
    assert got["ok", "poscar-potcar"] == (True, 0, 0) and got["ok", "incar-poscar"] == (True, 0, 0)
    assert got["order", "poscar-potcar"] == (False, 3, 0) and got["order", "incar-poscar"] == (False, 2, 0)
    assert got["alone", "incar-poscar"] == (True, 0, 2) and got["alone", "poscar-potcar"] == (True, 0, 1)
    assert got["broken", "file-format"][0] is False and got["broken", "incar-poscar"] == (True, 0, 1)
    assert ("ok", "file-format") not in {(r["dir"], r["rule"]) for r in files.run_validators(df).collect()}


def test_incar_rules(spark):
    from calcstrata.operators import files

    bad = ["ENCUT = -520", "ISMEAR = 10", "SIGMA = -0.05", "ISMEAR = 0\nSIGMA = 0.5", "NSW = -1", "ENCUT = 520"]
    df = spark.createDataFrame([(str(i), "INCAR", str(i), t) for i, t in enumerate(bad)], "file string, file_type string, blob_hash string, text string")
    got = {r["file"]: r["passed"] for r in files.validate(df).collect()}
    assert [got[str(i)] for i in range(6)] == [False] * 5 + [True]
