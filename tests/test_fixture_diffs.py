"""Hand-typed differences of the fixture texts: two versions of one or more files of each type."""

import pytest
from pyspark.sql import functions as F

from calcstrata.functions import scalars as S
from calcstrata.operators import diff as D
from calcstrata.plans import texts

#: file, ord, path, old, new, change, significance.
EXPECTED = {
    "INCAR": [("run/INCAR", 1000, "ENCUT", "520", "600", "modified", "critical"), ("run/INCAR", 1000, "ISMEAR", "0", "1", "modified", "critical"), ("run/INCAR", 1000, "LWAVE", None, "false", "added", "major"), ("run/INCAR", 1000, "SIGMA", "0.05", "0.1", "modified", "critical")],
    "KPOINTS": [
        ("retyped/KPOINTS", 1, "type", '"automatic"', '"line"', "modified", "critical"), ("run/KPOINTS", 2, "gamma_centered", "true", "false", "modified", "major"), ("run/KPOINTS", 3, "grid", "[4,4,4]", "[8,8,8]", "modified", "critical"),
        ("run/KPOINTS", 4, "shift", "[0.0,0.0,0.0]", "[0.5,0.5,0.5]", "modified", "major"), ("short/KPOINTS", 0, "$error", None, '"too few lines"', "modified", "critical"),
    ],
    "LAMMPS_INPUT": [
        ("run/in.melt", 4, "timestep", "0.005", "0.002", "modified", "critical"), ("run/in.melt", 5, "run", "50000", "200000", "modified", "critical"),
        ("run/in.melt", 13, "fix_nvt", '{"style":"nvt","Tstart":1.0,"Tstop":1.0,"Tdamp":0.1}', '{"style":"nvt","Tstart":1.0,"Tstop":1.0,"Tdamp":0.5}', "modified", "major"), ("run/in.melt", 16, "thermo", "100", "500", "modified", "minor"),
    ],
    "LAMMPS_DATA": [("run/data.lj", o, p, a, b, "modified", "critical") for o, p, a, b in ((1, "num_atoms", "500", "512"), (3, "lx", "20.0", "21.0"), (4, "ly", "20.0", "21.0"), (5, "lz", "20.0", "21.0"), (6, "volume", "8000.0", "9261.0"))],
    "LAMMPS_LOG": [
        ("run/log.lammps", o, p, a, b, "modified", s)
        for o, p, a, b, s in (
            (1, "final_etotal", "-1004.285", "-1007.8214", "critical"), (2, "final_pe", "-1005.4936", "-1009.0344", "critical"), (3, "final_ke", "1.813", "1.213", "minor"),
            (6, "run_steps", "50000", "200000", "major"), (7, "num_atoms", "500", "512", "major"), (9, "wall_time", '"0:00:14"', '"0:00:57"', "minor"),
        )
    ],
    "ORCA_INPUT": [
        ("run/water.inp", -2, "keyword.B3LYP", '"B3LYP"', None, "deleted", "critical"), ("run/water.inp", -2, "keyword.TIGHTSCF", '"TIGHTSCF"', None, "deleted", "major"), ("run/water.inp", -1, "keyword.PBE0", None, '"PBE0"', "added", "critical"),
        ("run/water.inp", -1, "keyword.VERYTIGHTSCF", None, '"VERYTIGHTSCF"', "added", "major"), ("run/water.inp", 5, "nprocs", "4", "8", "modified", "major"), ("run/water.inp", 1000, "block.geom.maxiter", "50", "100", "modified", "minor"),
        ("run/water.inp", 1000, "block.pal.nprocs", "4", "8", "modified", "major"),
    ],
    "ORCA_OUTPUT": [
        ("run/water.out", 1, "final_energy", "-76.4345661023", "-76.4401", "modified", "critical"), ("run/water.out", 2, "termination_status", '"normal"', '"error"', "modified", "critical"), ("run/water.out", 6, "scf_cycles", "9", "12", "modified", "major"),
    ],
}


@pytest.fixture(scope="module")
def versions(spark):
    df = spark.createDataFrame([(name, old, new) for name, (old, new) in texts.PAIRS.items()], "file string, old_text string, new_text string")
    digest = lambda c: S.sha256_hex(F.col(c).cast("binary"))
    return df.select("file", S.type_at_diff(F.col("file")).alias("file_type"), digest("old_text").alias("old_hash"), "old_text", digest("new_text").alias("new_hash"), "new_text")


@pytest.mark.parametrize("kind", sorted(EXPECTED))
def test_differences(versions, kind):
    got = D.ordered(D.diff_pairs(versions.where(F.col("file_type") == kind), [kind])).collect()
    columns = ("file", "ord", "path", "old_value", "new_value", "change_type", "significance")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(EXPECTED[kind], key=str)
    assert all(r["parse_error"] == (r["path"] == "$error") for r in got)
