"""One simulation file of each type for every order, and what parsing, comparing and checking them must give.

The texts are built from the order's key and values, so there are as many
files as orders and each differs. The expected facts are written in SQL from
the same numbers and never parse a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import diff as D
from ..operators import facts, files
from ..parsers import registry

#: Text of each type from the order's key ``k`` (SQL that Spark and DuckDB both read).
TEXTS = {
    "INCAR": r"""concat('SYSTEM = run ', k, '\n! ENCUT = 1\nENCUT = ', CASE WHEN k % 23 = 0 THEN 0 ELSE 300 + k % 5 * 50 END, '; ISMEAR = ', CASE WHEN k % 29 = 0 THEN 9 ELSE k % 9 - 3 END, '\nsigma = ', CASE WHEN k % 31 = 0 THEN '-0.15' ELSE concat('0.', k % 4, '5') END, ' # width\nNSW = ', k % 6 - 1, '\nLWAVE = ', CASE WHEN k % 2 = 0 THEN '.TRUE.' ELSE 'F' END, '\nMAGMOM = ', k % 3 + 1, '*0.5 1.0\nALGO = Fast\nALGO = Normal\n')""",
    "KPOINTS": r"""CASE WHEN k % 4 = 3 THEN concat('points\n2\nCartesian\n0 0 0 1\n0.5 0 0 ', k % 5 + 1, '\n')
  WHEN k % 4 = 2 THEN concat('bands\n', k % 30 + 10, '\nLine-mode\nReciprocal\n0 0 0 ! G\n0.5 0 0\n')
  WHEN k % 20 = 1 THEN 'short\n0\n'
  ELSE concat('mesh ', k, '\n0\n', CASE WHEN k % 8 = 0 THEN 'Gamma' ELSE 'Monkhorst' END, '\n', k % 7 + 1, ' 4 ', k % 3 + 2, '\n') END""",
    "OUTCAR": r"""CASE WHEN k % 11 = 0 THEN 'garbage' ELSE concat(' E-fermi :   ', k % 9, '.5     XC(G=0): -10.6\n', CASE WHEN k % 5 = 0 THEN '' ELSE concat('  free  energy   TOTEN  =       -', k % 90 + 1, '.25 eV\n  free  energy   TOTEN  =       -1.0 eV\n') END, CASE WHEN k % 3 = 0 THEN concat(' number of electron  10.0 magnetization  ', k % 7, '.5\n') ELSE '' END, ' Elapsed time (sec):       ', k % 50, '.5\n') END""",
    "LAMMPS_INPUT": r"""CASE WHEN k % 17 = 0 THEN '# nothing\n' ELSE concat(CASE WHEN k % 5 = 0 THEN '' ELSE 'units lj\n' END, CASE WHEN k % 37 = 0 THEN '' ELSE concat('pair_style lj/cut ', k % 4 + 1, '.5 # cut\n') END, 'boundary p p ', CASE WHEN k % 2 = 0 THEN 'f' ELSE 's' END, '\nminimize 0.5 0.25 ', k % 100 + 1, ' 1000\ndump 1 all atom ', k % 9 + 1, ' out.txt\nfix 2 all nvt temp 1.0 ', k % 4 + 1, '.0 0.1\nfix 2 all nvt temp 9.0 9.0 9.0\nfix 3 all npt temp 1.0 1.0 0.1 iso 0.0 ', k % 5, '.0 1.0\nmass 1 9.5\nmass 1 ', k % 3 + 1, '.5\nread_data "a b" # one\nvariable T equal ', k, '\nvariable S equal 1\nvariable T equal 2\nrestart ', k % 7 + 10, ' a b\ntimestep ', CASE WHEN k % 7 = 0 THEN '-0.5' ELSE '0.25' END, '\nfix 1 all nve\nrun 5\nrun &\n ', k % 900 + 1, '\n') END""",
    "LAMMPS_DATA": r"""CASE WHEN k % 13 = 0 THEN 'title\nno counts\n' ELSE concat('melt ', k, '\n\n', k % 50, ' atoms\n', k % 4, ' atom types\n', k % 6, ' bonds\n0.0 ', CASE WHEN k % 47 = 0 THEN '-0.5' ELSE concat(k % 20, '.5') END, ' xlo xhi\n0 ', CASE WHEN k % 41 = 0 THEN 0 ELSE 2 END, ' ylo yhi # box\n-1.0 ', CASE WHEN k % 43 = 0 THEN '-3' ELSE concat(k % 3, '.0') END, ' zlo zhi\n', k % 3, '.5 0.0 -1.5 xy xz yz\n\nMasses # kinds\n\n1 ', k % 30 + 1, '.5\n\nAtoms\n\n1 1 0 0 0\n') END""",
    "LAMMPS_LOG": r"""concat('  ', k % 40, ' atoms\n', CASE WHEN k % 6 = 4 THEN concat('TotEng   -1.5\nTotEng   -', k % 70, '.5\nTemp  99.5\nTemp  ', k % 8, '.5\n')
  WHEN k % 6 = 5 THEN concat('---\nkeywords: [\'Step\', \'Temp\', \'PotEng\', ]\ndata:\n  - [0, 1.5, -2.5, ]\n\n  - [', k % 1000 + 1, ', 1.25, -3.5, ]\n...\nkeywords: [\'Step\', \'Temp\', \'PotEng\', ]\ndata:\n  - [', k % 1000 + 1, ', 1.25, -3.5, ]\n  - [', k % 1000 + 11, ', ', k % 8, '.5, -4.5, ]\n...\n')
  ELSE concat('Step Temp PotEng\n0 1.5 -2.5\n', k % 1000 + 1, ' 1.25 -', k % 70, '.5\nLoop time of 1\nStep Temp PotEng\n', k % 1000 + 1, ' 1.25 -3.5\n', k % 1000 + 11, ' ', k % 8, '.5 -4.5\nLoop time of 1\n') END, CASE WHEN k % 3 = 0 THEN '' ELSE concat('Total wall time: 0:00:', k % 50 + 10, '\n') END)""",
    "ORCA_INPUT": r"""concat(CASE WHEN k % 6 = 0 THEN '' ELSE '! b3lyp Opt def2-TZVP b3lyp\n' END, '%maxcore ', k % 4000 + 1, ' # memory\n%pal nprocs ', k % 16 + 1, ' end\n%scf\n  MaxIter ', k % 200, '\nend\n', CASE WHEN k % 5 = 0 THEN '' WHEN k % 10 = 7 THEN concat('* xyzfile ', k % 3 - 1, ' ', k % 3, ' geo', k % 4, '.xyz\n') ELSE concat('* xyz ', k % 3 - 1, ' ', k % 3, '\nO 0 0 0\nH 0 0 1\n*\n') END, '$new_job\n! HF\n')""",
    "ORCA_OUTPUT": r"""CASE WHEN k % 19 = 0 THEN 'nothing here' ELSE concat('Program Version 5.0.', k % 5, '\n', CASE WHEN k % 4 = 0 THEN 'SCF not converged\n' WHEN k % 4 = 1 THEN concat('SCF CONVERGED AFTER  ', k % 30 + 1, ' CYCLES\n') ELSE '' END, CASE WHEN k % 7 = 0 THEN '' ELSE concat('FINAL SINGLE POINT ENERGY      -70.5\nFINAL SINGLE POINT ENERGY      -', k % 80 + 1, '.25\n') END, CASE WHEN k % 6 = 1 THEN 'Total Energy       :    -2.00000000 Eh    -54.422772491976 eV\n' ELSE '' END, CASE WHEN k % 8 = 3 THEN concat('Total Dipole Moment    :   -3.0   4.0   ', k % 3 * 12, '.0\n') ELSE '' END, CASE k % 3 WHEN 0 THEN 'THE OPTIMIZATION HAS CONVERGED\n' WHEN 1 THEN 'THE OPTIMIZATION HAS NOT CONVERGED\n' ELSE '' END, CASE WHEN k % 5 = 0 THEN 'ERROR TERMINATION\n' ELSE '****ORCA TERMINATED NORMALLY****\n' END) END""",
}

_QUOTED = "concat('\"', {0}, '\"')"


def _text(value: str) -> str:
    return _QUOTED.format(value)


def _int(path: str, n: str, when: str = "true") -> tuple[str, str, str, str, str]:
    return (f"'{path}'", "int", n, f"CAST({n} AS VARCHAR)", when)


def _real(path: str, n: str, when: str = "true") -> tuple[str, str, str, str, str]:
    return (f"'{path}'", "double", n, f"CAST(CAST({n} AS DOUBLE) AS VARCHAR)", when)


def _flag(path: str, c: str, when: str = "true") -> tuple[str, str, str, str, str]:
    return (f"'{path}'", "bool", f"CASE WHEN {c} THEN 1 ELSE 0 END", f"CASE WHEN {c} THEN 'true' ELSE 'false' END", when)


def _string(path: str, v: str, when: str = "true") -> tuple[str, str, str, str, str]:
    return (f"'{path}'", "string", "NULL", _text(v), when)


def _json(path: str, v: str, when: str = "true") -> tuple[str, str, str, str, str]:
    return (f"'{path}'", "json", "NULL", v, when)


def _error(message: str, when: str) -> tuple[str, str, str, str, str]:
    return ("'$error'", "string", "NULL", f"'\"{message}\"'", when)


_AUTO = "k % 4 < 2 AND k % 20 <> 1"
_SCRIPT, _DATA, _OUT, _QC = "k % 17 <> 0", "k % 13 <> 0", "k % 11 <> 0", "k % 19 <> 0"
_LX, _LY, _LZ = "(CASE WHEN k % 47 = 0 THEN -0.5 ELSE k % 20 + 0.5 END)", "(CASE WHEN k % 41 = 0 THEN 0 ELSE 2 END)", "(CASE WHEN k % 43 = 0 THEN -2 ELSE k % 3 + 1 END)"
#: Expected facts (path, kind, number, JSON text, condition) of each type.
FACTS = {
    "INCAR": [
        _string("SYSTEM", "'run ' || k"), _int("ENCUT", "CASE WHEN k % 23 = 0 THEN 0 ELSE 300 + k % 5 * 50 END"), _int("ISMEAR", "CASE WHEN k % 29 = 0 THEN 9 ELSE k % 9 - 3 END"),
        _real("SIGMA", "CASE WHEN k % 31 = 0 THEN -0.15 ELSE (k % 4 * 10 + 5) / 100.0 END"), _int("NSW", "k % 6 - 1"), _flag("LWAVE", "k % 2 = 0"),
        _json("MAGMOM", "'[' || repeat('0.5,', CAST(k % 3 + 1 AS INT)) || '1.0]'"), _string("ALGO", "'Normal'"),
    ],
    "KPOINTS": [
        _string("type", "CASE WHEN k % 4 = 3 THEN 'explicit' WHEN k % 4 = 2 THEN 'line' ELSE 'automatic' END", "k % 20 <> 1"), _string("comment", "CASE WHEN k % 4 = 3 THEN 'points' WHEN k % 4 = 2 THEN 'bands' ELSE 'mesh ' || k END", "k % 20 <> 1"),
        _flag("gamma_centered", "k % 8 = 0", _AUTO), _json("grid", "'[' || (k % 7 + 1) || ',4,' || (k % 3 + 2) || ']'", _AUTO), _json("shift", "'[0.0,0.0,0.0]'", _AUTO),
        _int("num_kpoints", "2", "k % 4 = 3"), _flag("cartesian", "true", "k % 4 = 3"), _json("kpoints", """'[{"coords":[0.0,0.0,0.0],"weight":1.0},{"coords":[0.5,0.0,0.0],"weight":' || (k % 5 + 1) || '.0}]'""", "k % 4 = 3"),
        _int("num_points", "k % 30 + 10", "k % 4 = 2"), _flag("reciprocal", "true", "k % 4 = 2"), _int("num_segments", "1", "k % 4 = 2"),
        _json("segments", """'[{"start":{"coords":[0.0,0.0,0.0],"label":"G"},"end":{"coords":[0.5,0.0,0.0],"label":""}}]'""", "k % 4 = 2"), _error("too few lines", "k % 20 = 1"),
    ],
    "OUTCAR": [
        _real("final_energy", "-(k % 90 + 1.25)", f"{_OUT} AND k % 5 <> 0"), _real("efermi", "k % 9 + 0.5", _OUT), _real("total_magnetization", "k % 7 + 0.5", f"{_OUT} AND k % 3 = 0"), _flag("is_stopped", "false", _OUT), _json("run_stats", """'{"Elapsed time (sec):' || (k % 50) || '.5}'""".replace("(sec):", '(sec)":'), _OUT),
        _json("magnetization", "'[]'", _OUT), _json("charge", "'[]'", _OUT), _error("no energy and no Fermi level", "k % 11 = 0"),
    ],
    "LAMMPS_INPUT": [
        _string("units", "'lj'", f"{_SCRIPT} AND k % 5 <> 0"), _string("pair_style", "'lj/cut ' || (k % 4 + 1) || '.5'", f"{_SCRIPT} AND k % 37 <> 0"), _string("boundary", "'p p ' || CASE WHEN k % 2 = 0 THEN 'f' ELSE 's' END", _SCRIPT),
        _real("minimize_etol", "0.5", _SCRIPT), _real("minimize_ftol", "0.25", _SCRIPT), _int("minimize_maxiter", "k % 100 + 1", _SCRIPT), _int("minimize_maxeval", "1000", _SCRIPT), _int("dump_interval", "k % 9 + 1", _SCRIPT),
        _json("fix_nvt", """'{"style":"nvt","Tstart":1.0,"Tstop":' || (k % 4 + 1) || '.0,"Tdamp":0.1}'""", _SCRIPT), _json("fix_npt", """'{"style":"npt","Tstart":1.0,"Tstop":1.0,"Tdamp":0.1,"press_style":"iso","Pstart":0.0,"Pstop":' || (k % 5) || '.0,"Pdamp":1.0}'""", _SCRIPT),
        _real("timestep", "CASE WHEN k % 7 = 0 THEN -0.5 ELSE 0.25 END", _SCRIPT), _int("run", "k % 900 + 1", _SCRIPT),
        _flag("fix_nve", "true", _SCRIPT), _json("read_data", """'["a b"]'""", _SCRIPT), _json("variable_names", """'["T","S"]'""", _SCRIPT), _json("mass", """'{"1":' || (k % 3 + 1) || '.5}'""", _SCRIPT), _int("restart_interval", "k % 7 + 10", _SCRIPT), _error("the script is empty", "k % 17 = 0"),
    ],
    "LAMMPS_DATA": [
        _string("title", "'melt ' || k", _DATA), _int("num_atoms", "k % 50", _DATA), _int("num_atom_types", "k % 4", _DATA), _int("num_bonds", "k % 6", _DATA),
        _real("xlo", "0", _DATA), _real("xhi", _LX, _DATA), _real("lx", _LX, _DATA), _real("ylo", "0", _DATA), _real("yhi", _LY, _DATA), _real("ly", _LY, _DATA), _real("zlo", "-1", _DATA), _real("zhi", f"{_LZ} - 1", _DATA), _real("lz", _LZ, _DATA),
        _real("xy", "k % 3 + 0.5", _DATA), _real("xz", "0", _DATA), _real("yz", "-1.5", _DATA),
        _real("volume", f"{_LX} * {_LY} * {_LZ}", _DATA), _flag("has_bonds", "k % 6 > 0", _DATA), _json("sections", """'["Masses","Atoms"]'""", _DATA), _json("masses", """'{"1":' || (k % 30 + 1) || '.5}'""", _DATA), _error("no number of atoms", "k % 13 = 0"),
    ],
    "LAMMPS_LOG": [
        _int("final_step", "k % 1000 + 11", "k % 6 <> 4"), _real("final_temp", "k % 8 + 0.5"), _real("final_etotal", "-(k % 70 + 0.5)", "k % 6 = 4"), _real("final_pe", "-4.5", "k % 6 <> 4"), _int("run_steps", "k % 1000 + 11", "k % 6 <> 4"), _int("num_atoms", "k % 40"), _string("wall_time", "'0:00:' || (k % 50 + 10)", "k % 3 <> 0"), _flag("completed", "k % 3 <> 0"),
        _json("thermo_keywords", """'["Step","Temp","PotEng"]'""", "k % 6 <> 4"),
    ],
    "ORCA_INPUT": [
        _json("keywords", """CASE WHEN k % 6 = 0 THEN '[]' ELSE '["B3LYP","DEF2-TZVP","OPT"]' END"""), _int("charge", "k % 3 - 1", "k % 5 <> 0"), _int("multiplicity", "k % 3", "k % 5 <> 0"), _string("coord_format", "CASE WHEN k % 10 = 7 THEN 'xyzfile' ELSE 'xyz' END", "k % 5 <> 0"), _string("xyzfile", "'geo' || (k % 4) || '.xyz'", "k % 10 = 7"), _int("maxcore", "k % 4000 + 1"),
        _int("nprocs", "k % 16 + 1"), _json("coordinates", """'["O 0 0 0","H 0 0 1"]'""", "k % 5 <> 0 AND k % 10 <> 7"), _int("block.pal.nprocs", "k % 16 + 1"), _int("block.scf.maxiter", "k % 200"),
    ],
    "ORCA_OUTPUT": [
        _real("final_energy", "CASE WHEN k % 7 = 0 THEN -2.0 ELSE -(k % 80 + 1.25) END", f"{_QC} AND (k % 7 <> 0 OR k % 6 = 1)"), _real("dipole_moment", "CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 13 ELSE round(sqrt(601), 6) END", f"{_QC} AND k % 8 = 3"), _string("termination_status", "CASE WHEN k % 5 = 0 THEN 'error' ELSE 'normal' END", _QC), _flag("optimization_converged", "k % 3 = 0", f"{_QC} AND k % 3 < 2"),
        _int("scf_cycles", "k % 30 + 1", f"{_QC} AND k % 4 = 1"), _flag("scf_converged", "k % 4 = 1", f"{_QC} AND k % 4 < 2"), _string("orca_version", "'5.0.' || (k % 5)", _QC), _error("no energy, end or version", "k % 19 = 0"),
    ],
}

#: Keys of the old and the new version of a file that is compared.
_OLD, _NEW = "k", "(k + 2)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys dealt out to all cores: a file of few row groups would be parsed by as few tasks."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    return keys.repartition(4 * spark.sparkContext.defaultParallelism, "k")


def _spark_text(kind: str, key: str = "k") -> str:
    return TEXTS[kind].replace("k % ", f"{key} % ").replace(", k,", f", {key},")


def generated(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """blob_hash (the key), file_type, text."""
    return orders(spark, sf_dir).select(F.col("k").cast("string").alias("blob_hash"), F.lit(kind).alias("file_type"), F.expr(_spark_text(kind)).alias("text"))


def _parse(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return registry.facts_of(generated(spark, sf_dir, kind), [kind]).select(F.col("blob_hash").alias("blob"), "path", "kind", "num", "value")

    return query


def facts_sql(kind: str, key: str = "k") -> str:
    one = ["{{'path': {}, 'kind': '{}', 'num': CAST({} AS DOUBLE), 'value': {}, 'ok': {}}}".format(*(x.replace("k % ", f"{key} % ").replace("|| k", f"|| {key}") for x in f)) for f in FACTS[kind]]
    return f"SELECT k, f.path AS path, f.kind AS kind, f.num AS num, f.value AS value FROM (SELECT k, unnest([{', '.join(one)}]) AS f FROM (SELECT o_orderkey AS k FROM orders)) WHERE f.ok"


def _parse_sql(kind: str) -> str:
    return f"SELECT CAST(k AS VARCHAR) AS blob, path, kind, num, value FROM ({facts_sql(kind)})"


def versions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    side = lambda s, key: F.expr(_spark_text(kind, key)).alias(f"{s}_text")
    pairs = orders(spark, sf_dir).select(F.col("k").cast("string").alias("file"), F.lit(kind).alias("file_type"), side("old", _OLD), side("new", _NEW))
    digest = lambda s: S.sha256_hex(F.col(f"{s}_text").cast("binary")).alias(f"{s}_hash")
    return pairs.select("*", digest("old"), digest("new"))


def diff_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every INCAR."""
    return D.diff_pairs(versions(spark, sf_dir, "INCAR"), ["INCAR"]).select("file", "path", "old_value", "new_value", "change_type", "significance")


def diff_outcar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every output; one that cannot be parsed gives one row."""
    return D.diff_pairs(versions(spark, sf_dir, "OUTCAR"), ["OUTCAR"]).select("file", "path", "old_value", "new_value", "change_type", "significance", "parse_error")


def diff_files_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, K7: a summary of each compared file."""
    return facts.summarize(D.diff_pairs(versions(spark, sf_dir, "INCAR"), ["INCAR"]), ["file"])


_CRITICAL = "('ENCUT', 'ISMEAR', 'SIGMA', 'NSW', 'ALGO', 'final_energy', 'efermi')"
_MAJOR = "('LWAVE', 'MAGMOM')"
_DIFF_INCAR = f"""SELECT CAST(coalesce(n.k, o.k) AS VARCHAR) AS file, coalesce(n.path, o.path) AS path, o.value AS old_value, n.value AS new_value,
CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'deleted' ELSE 'modified' END AS change_type, CASE WHEN coalesce(n.path, o.path) IN {_CRITICAL} THEN 'critical' WHEN coalesce(n.path, o.path) IN {_MAJOR} THEN 'major' ELSE 'minor' END AS significance
FROM ({facts_sql("INCAR", _NEW)}) n FULL OUTER JOIN ({facts_sql("INCAR", _OLD)}) o ON n.k = o.k AND n.path = o.path WHERE n.value IS DISTINCT FROM o.value"""
_DIFF_OUTCAR = f"""SELECT CAST(k AS VARCHAR) AS file, path, old_value, new_value, CASE WHEN path = '$error' THEN 'modified' WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'deleted' ELSE 'modified' END AS change_type,
CASE WHEN path IN {_CRITICAL} OR path = '$error' THEN 'critical' WHEN path = 'total_magnetization' THEN 'major' ELSE 'minor' END AS significance, path = '$error' AS parse_error
FROM (SELECT coalesce(n.k, o.k) AS k, coalesce(n.path, o.path) AS path, o.value AS old_value, n.value AS new_value, bool_or(coalesce(n.path, o.path) = '$error') OVER (PARTITION BY coalesce(n.k, o.k)) AS failed
  FROM (SELECT * FROM ({facts_sql("OUTCAR", _NEW)}) WHERE path NOT IN ('magnetization', 'charge')) n FULL OUTER JOIN (SELECT * FROM ({facts_sql("OUTCAR", _OLD)}) WHERE path NOT IN ('magnetization', 'charge')) o ON n.k = o.k AND n.path = o.path)
WHERE (path = '$error' OR NOT failed) AND (path = '$error' OR old_value IS DISTINCT FROM new_value)"""
_SUMMARY = f"""SELECT file, count(*) AS total_changes, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'deleted') AS deleted, count(*) FILTER (change_type = 'modified') AS modified,
count(*) FILTER (significance = 'critical') AS critical, count(*) FILTER (significance = 'major') AS major, count(*) FILTER (significance = 'minor') AS minor, bool_or(significance = 'critical') AS has_critical_changes FROM ({_DIFF_INCAR}) GROUP BY file"""

#: Messages of the rules (condition, message) of each type, in the rules' order; a parse error silences the others.
_RULES = {
    "INCAR": [
        ("k % 23 = 0", "ENCUT must be positive"), ("k % 29 = 0", "ISMEAR must be from -5 to 5"), ("k % 31 = 0", "SIGMA must be positive"), ("k % 6 = 0", "NSW must not be negative"),
        ("k % 9 = 3 AND k % 29 <> 0 AND k % 4 > 1 AND k % 31 <> 0", "SIGMA over 0.2 is too wide for ISMEAR 0"),
    ],
    "KPOINTS": [("k % 20 = 1", "cannot be parsed: \"too few lines\"")],
    "OUTCAR": [("k % 11 = 0", "cannot be parsed: \"no energy and no Fermi level\""), ("k % 11 <> 0 AND k % 5 = 0", "the run stopped or has no final energy")],
    "LAMMPS_INPUT": [("k % 17 = 0", "cannot be parsed: \"the script is empty\""), ("k % 17 <> 0 AND k % 5 = 0", "units are missing"), ("k % 17 <> 0 AND k % 37 = 0", "pair_style is missing"), ("k % 17 <> 0 AND k % 7 = 0", "timestep must be positive")],
    "LAMMPS_DATA": [("k % 13 = 0", "cannot be parsed: \"no number of atoms\""), ("k % 13 <> 0 AND k % 50 = 0", "there must be atoms"), ("k % 13 <> 0 AND k % 4 = 0", "there must be atom types"), ("k % 13 <> 0 AND k % 47 = 0", "lx must be positive"), ("k % 13 <> 0 AND k % 41 = 0", "ly must be positive"), ("k % 13 <> 0 AND k % 43 = 0", "lz must be positive")],
    "LAMMPS_LOG": [("k % 3 = 0", "the run did not complete"), ("k % 40 = 0", "there must be atoms")],
    "ORCA_INPUT": [("k % 6 = 0", "keywords are missing"), ("k % 5 = 0", "the charge is missing"), ("k % 5 <> 0 AND k % 3 = 0", "the multiplicity must be at least 1")],
    "ORCA_OUTPUT": [("k % 19 = 0", "cannot be parsed: \"no energy, end or version\""), ("k % 19 <> 0 AND k % 5 = 0", "the run did not end normally"), ("k % 19 <> 0 AND k % 7 = 0 AND k % 6 <> 1", "there is no final energy"), ("k % 19 <> 0 AND k % 3 = 1", "the optimization did not converge")],
}


def _validate(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = generated(spark, sf_dir, kind).withColumn("file", F.col("blob_hash"))
        return files.validate(own, [kind]).select("file", "passed", F.concat_ws("; ", "errors").alias("errors"))

    return query


def _validate_sql(kind: str) -> str:
    told = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in _RULES[kind])
    broken = " OR ".join(f"({c})" for c, _ in _RULES[kind])
    return f"SELECT CAST(k AS VARCHAR) AS file, NOT ({broken}) AS passed, concat_ws('; ', {told}) AS errors FROM (SELECT o_orderkey AS k FROM orders)"


#: A directory of every order: files by name, with the condition under which they are there.
DIRECTORY = {
    "POSCAR": ("true", r"""CASE WHEN k % 9 = 4 THEN 'cell\n1.0\n3 0 0\n' ELSE concat('cell\n', CASE WHEN k % 59 = 1 THEN '0.0' ELSE '1.0' END, '\n3 0 0\n0 3', CASE WHEN k % 59 = 2 THEN '' ELSE ' 0' END, '\n0 0 3\n', CASE WHEN k % 59 = 3 THEN '1 2' ELSE 'Li Co' END, '\n', CASE k % 59 WHEN 4 THEN '1 x' WHEN 5 THEN '1 2 3' WHEN 6 THEN '5 5' WHEN 7 THEN '1 -1' ELSE concat('1 ', k % 3 + 1) END, '\n', CASE WHEN k % 9 = 5 THEN 'X' ELSE 'Direct' END, '\n0 0 0\n0.5 0.5 0.5\n0.5 0 0\n0 0 0.5\n') END"""),
    "POTCAR": ("k % 4 > 0", r"""concat('  TITEL  = PAW_PBE ', CASE WHEN k % 4 = 1 THEN 'Li_sv' WHEN k % 4 = 2 THEN 'Co' ELSE 'Si' END, ' 05Jan2001\n  TITEL  = PAW_PBE ', CASE WHEN k % 4 = 2 THEN 'Li' ELSE 'Co' END, ' 05Jan2001\n')"""),
    "INCAR": ("k % 5 > 0", r"""CASE WHEN k % 19 = 0 THEN 'garbage' ELSE concat('ISPIN = 2\n', CASE WHEN k % 2 = 0 THEN concat('MAGMOM = ', k % 4 + 1, '*0.6\n') ELSE '' END, CASE WHEN k % 3 = 0 THEN 'LDAUU = 5 5 5\n' ELSE 'LDAUU = 3\n' END, CASE WHEN k % 13 = 0 THEN 'LDAUJ = 1 1 1 1\n' WHEN k % 13 = 1 THEN 'LDAUJ = 1 1\n' ELSE '' END, CASE WHEN k % 17 = 0 THEN 'LDAUL = 3*2\n' ELSE 'LDAUL = 2*2\n' END, 'ISIF = ', k % 4, '\n') END"""),
    "KPOINTS": ("k % 6 = 0", r"""CASE WHEN k % 12 = 0 THEN 'mesh\n0\nGamma\nnot a number\n' ELSE 'mesh\n0\nGamma\n4 4 4\n' END"""),
}


def validate_directories(spark: SparkSession, sf_dir: str, config: dict[str, bool] | None = None) -> DataFrame:
    """Three rule sets over a directory of each order."""
    entry = lambda name, when, text: F.when(F.expr(when), F.struct(F.concat(F.lit("d"), F.col("k").cast("string"), F.lit(f"/{name}")).alias("path"), F.expr(text).alias("text")))
    each = F.filter(F.array(*(entry(n, w, t) for n, (w, t) in DIRECTORY.items())), lambda x: x.isNotNull())
    table = orders(spark, sf_dir).select(F.explode(each).alias("f")).select("f.*")
    out = files.run_validators(table, config or {"file-format": True})
    return out.select("dir", "rule", "priority", "passed", F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"))


#: POSCAR of k: whether it is cut off, its elements and counts, and whether it can be read.
_DIRECTORIES_SQL = r"""WITH q AS (SELECT o_orderkey AS k, o_orderkey % 59 AS v, o_orderkey % 9 = 4 AS cut, o_orderkey % 5 > 0 AND o_orderkey % 19 = 0 AS garbage FROM orders),
o AS (SELECT *, CASE WHEN v = 3 THEN ['1', '2'] ELSE ['Li', 'Co'] END AS a, [CASE k % 4 WHEN 1 THEN 'Li' WHEN 2 THEN 'Co' ELSE 'Si' END, CASE k % 4 WHEN 2 THEN 'Li' ELSE 'Co' END] AS b,
  CASE v WHEN 5 THEN 6 WHEN 6 THEN 10 WHEN 7 THEN 0 ELSE k % 3 + 2 END AS atoms, NOT cut AND v <> 4 AS readable FROM q),
p AS (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x)) AS missing, list_filter(b, lambda x: NOT list_contains(a, x)) AS extra, list_filter([CASE WHEN a[1] <> b[1] THEN '1: ' || a[1] || ' vs ' || b[1] END, CASE WHEN a[2] <> b[2] THEN '2: ' || a[2] || ' vs ' || b[2] END], lambda x: x IS NOT NULL) AS places FROM o),
t AS (
  SELECT k, 'file-format' AS rule, 5 AS priority, [CASE WHEN cut THEN 'POSCAR has fewer than 8 lines' END, CASE WHEN NOT cut AND v = 1 THEN 'POSCAR: the scale must be a number other than zero' END, CASE WHEN NOT cut AND v = 2 THEN 'POSCAR: lattice rows need three numbers' END,
    CASE WHEN NOT cut AND v = 3 THEN 'POSCAR: the line of elements has numbers' END, CASE WHEN NOT cut AND v IN (4, 7) THEN 'POSCAR: counts must be whole and not negative' END, CASE WHEN NOT cut AND v = 5 THEN 'POSCAR: numbers of elements and counts differ' END,
    CASE WHEN NOT cut AND k % 9 = 5 THEN 'POSCAR: the coordinate mode must be C, D or K' END, CASE WHEN readable AND atoms > 4 THEN 'POSCAR: coordinate rows are missing' END,
    nullif(array_to_string(list_filter([CASE WHEN garbage THEN 'INCAR cannot be parsed' END, CASE WHEN k % 12 = 0 THEN 'KPOINTS cannot be parsed' END], lambda x: x IS NOT NULL), '; '), '')] AS e, [NULL::VARCHAR] AS w FROM p
  UNION ALL
  SELECT k, 'poscar-potcar', 10, CASE WHEN k % 4 = 0 THEN [NULL] WHEN NOT readable THEN ['POSCAR cannot be read'] ELSE
    [CASE WHEN len(missing) > 0 THEN 'not in POTCAR: ' || array_to_string(missing, ', ') END, CASE WHEN len(extra) > 0 THEN 'not in POSCAR: ' || array_to_string(extra, ', ') END, CASE WHEN len(places) > 0 THEN 'order differs at ' || array_to_string(places, ', ') END] END, [CASE WHEN k % 4 = 0 THEN 'POTCAR is missing' END] FROM p
  UNION ALL
  SELECT k, 'incar-poscar', 20, CASE WHEN garbage OR NOT readable THEN [NULL] ELSE [CASE WHEN k % 2 = 0 AND k % 4 + 1 <> atoms THEN 'MAGMOM has ' || (k % 4 + 1) || ' values for ' || atoms || ' atoms' END,
    CASE WHEN k % 3 = 0 THEN 'LDAUU has 3 values for 2 species' END, CASE WHEN k % 13 = 0 THEN 'LDAUJ has 4 values for 2 species' END, CASE WHEN k % 17 = 0 THEN 'LDAUL has 3 values for 2 species' END] END,
    [CASE WHEN NOT readable THEN 'POSCAR cannot be read, checks skipped' END, CASE WHEN garbage THEN 'INCAR cannot be read, checks skipped' END, CASE WHEN readable AND NOT garbage AND k % 2 = 1 THEN 'ISPIN = 2 without MAGMOM' END, CASE WHEN readable AND NOT garbage AND k % 4 = 3 THEN 'NSW = 0 makes ISIF of 3 or more useless' END] FROM p WHERE k % 5 > 0)
SELECT 'd' || k AS dir, rule, priority, len(list_filter(e, lambda x: x IS NOT NULL)) = 0 AS passed, array_to_string(list_filter(e, lambda x: x IS NOT NULL), '; ') AS errors, array_to_string(list_filter(w, lambda x: x IS NOT NULL), '; ') AS warnings FROM t"""


def _diff_of(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.diff_pairs(versions(spark, sf_dir, kind), [kind]).select("file", "file_type", "ord", "path", "old_value", "new_value", "change_type", "significance", "parse_error")

    return query


#: Compared paths of each type: place, path, significance; and whether changes always count as modified.
_COMPARED = {
    "INCAR": [(1000, p, "critical") for p in ("ENCUT", "ISMEAR", "SIGMA", "NSW", "ALGO")] + [(1000, p, "major") for p in ("LWAVE", "MAGMOM")] + [(1000, "SYSTEM", "minor")],
    "KPOINTS": [(1, "type", "critical"), (2, "gamma_centered", "major"), (3, "grid", "critical"), (4, "shift", "major"), (5, "num_kpoints", "critical"), (6, "cartesian", "major"), (7, "num_points", "minor"), (8, "num_segments", "major")],
    "LAMMPS_INPUT": [
        (1, "units", "critical"), (2, "pair_style", "critical"), (4, "timestep", "critical"), (5, "run", "critical"), (6, "minimize_etol", "critical"), (7, "minimize_ftol", "critical"), (8, "minimize_maxiter", "critical"), (9, "minimize_maxeval", "critical"),
        (10, "boundary", "major"), (13, "fix_nvt", "major"), (14, "fix_npt", "major"), (15, "fix_nve", "major"), (18, "read_data", "minor"), (19, "variable_names", "minor"), (20, "mass", "minor"),
    ],
    "LAMMPS_DATA": [(1, "num_atoms", "critical"), (2, "num_atom_types", "critical"), (3, "lx", "critical"), (4, "ly", "critical"), (5, "lz", "critical"), (6, "volume", "critical"), (7, "has_bonds", "major"), (8, "num_bonds", "major"), (16, "title", "minor"), (17, "masses", "major")],
    "LAMMPS_LOG": [(1, "final_etotal", "critical"), (2, "final_pe", "critical"), (4, "final_temp", "major"), (6, "run_steps", "major"), (7, "num_atoms", "major"), (8, "completed", "critical"), (9, "wall_time", "minor")],
    "ORCA_OUTPUT": [(1, "final_energy", "critical"), (2, "termination_status", "critical"), (3, "optimization_converged", "critical"), (6, "scf_cycles", "major"), (7, "scf_converged", "major"), (8, "orca_version", "minor")],
}
_SET_LIKE = "('read_data', 'variable_names', 'mass', 'masses')"


def _diff_sql(kind: str) -> str:
    """Both versions' facts side by side; an error, or another kind of grid, leaves no other row of its file."""
    told = ", ".join(f"('{p}', {o}, '{s}')" for o, p, s in [(0, "$error", "critical"), *_COMPARED[kind]])
    retyped = "bool_or(path = 'type' AND o IS DISTINCT FROM n) OVER (PARTITION BY k)" if kind == "KPOINTS" else "false"
    change = "'modified'" if kind == "KPOINTS" else f"CASE WHEN path = '$error' OR path IN {_SET_LIKE} THEN 'modified' WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' ELSE 'modified' END"
    return f"""WITH j AS (SELECT coalesce(n.k, o.k) AS k, coalesce(n.path, o.path) AS path, o.value AS o, n.value AS n FROM ({facts_sql(kind, _NEW)}) n FULL OUTER JOIN ({facts_sql(kind, _OLD)}) o ON n.k = o.k AND n.path = o.path),
c AS (SELECT j.*, t.ord, t.s, bool_or(path = '$error') OVER (PARTITION BY k) AS failed, {retyped} AS retyped FROM j JOIN (VALUES {told}) t(path, ord, s) USING (path))
SELECT CAST(k AS VARCHAR) AS file, '{kind}' AS file_type, CAST(ord AS INTEGER) AS ord, path, o AS old_value, n AS new_value, {change} AS change_type, s AS significance, path = '$error' AS parse_error
FROM c WHERE path = '$error' OR NOT failed AND (path = 'type' OR NOT retyped) AND o IS DISTINCT FROM n"""


QUERIES = (
    {f"parse_{k.lower()}": _parse(k) for k in TEXTS}
    | {f"validate_{k.lower()}": _validate(k) for k in TEXTS}
    | {f"diff_{k.lower()}": _diff_of(k) for k in _COMPARED}
    | {"diff_generated": diff_generated, "diff_outcar": diff_outcar, "diff_files_summary": diff_files_summary, "validate_directories": validate_directories}
)
ORACLE = (
    {f"parse_{k.lower()}": _parse_sql(k) for k in TEXTS}
    | {f"validate_{k.lower()}": _validate_sql(k) for k in TEXTS}
    | {f"diff_{k.lower()}": _diff_sql(k) for k in _COMPARED}
    | {"diff_generated": _DIFF_INCAR, "diff_outcar": _DIFF_OUTCAR, "diff_files_summary": _SUMMARY, "validate_directories": _DIRECTORIES_SQL}
)
