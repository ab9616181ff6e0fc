"""Molecular-dynamics files: input scripts, data files and thermo logs as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import values as V
from .dft import lines_of

_UNCOMMENT = r"""^((?:[^#'"]|'[^']*'|"[^"]*")*)#.*$"""


def script_commands(text: Column) -> Column:
    """Array of the words of each command: comments gone, ``&`` joined, quotes taken off."""
    bare = lambda x: F.trim(F.when(x.contains("#"), F.regexp_replace(x, _UNCOMMENT, "$1")).otherwise(x))
    kept = F.filter(F.transform(lines_of(text), bare), lambda x: x != "")
    joined = F.split(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]*&[ \t]*\n[ \t]*", " "), "\n")
    word = lambda w: F.when(w.rlike("""^(".*"|'.*')$"""), w.substr(F.lit(2), F.length(w) - 2)).otherwise(w)
    parts = lambda x: F.transform(F.regexp_extract_all(x, F.lit("""("[^"]*"|'[^']*'|\\S+)"""), F.lit(1)), word)
    split = lambda x: F.when(x.contains("'") | x.contains('"'), parts(x)).otherwise(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)))
    return F.filter(F.transform(joined, split), lambda t: F.size(t) > 0)


def _named(*names: str, least: int = 2) -> Column:
    """The words of the commands of these names with at least so many words."""
    return F.transform(F.filter("c", lambda x: x["name"].isin(*names) & (F.size(x["t"]) >= least)), lambda x: x["t"])


def parse_script(files: DataFrame) -> DataFrame:
    """Settings of an input script, unexpanded; which of several commands counts depends on the command."""
    rows = V.computed(files, c=F.transform(script_commands(F.col("text")), lambda t: F.struct(F.lower(t[0]).alias("name"), t.alias("t")))).select("blob_hash", "c")
    used = ("units", "pair_style", "kspace_style", "timestep", "run", "boundary", "atom_style", "dimension", "thermo", "pair_coeff", "neigh_modify")
    rows = V.computed(rows, **{f"c_{n}": _named(n) for n in used}, c_minimize=_named("minimize", least=5), c_mass=_named("mass", least=3), c_fix=_named("fix", least=4))
    found = {f"last_{n}": F.try_element_at(f"c_{n}", F.lit(-1)) for n in (*used, "minimize")} | {f"first_{n}": F.try_element_at(f"c_{n}", F.lit(1)) for n in used}

    last = lambda n: F.col(f"last_{n}")
    first = lambda n: F.col(f"first_{n}")
    rest = lambda t: F.array_join(F.slice(t, 2, F.size(t)), " ")
    minimize = last("minimize")
    masses = F.col("c_mass")
    mass_types = F.array_sort(F.array_distinct(F.transform(masses, lambda t: t[1])))
    mass_last = lambda k: F.element_at(F.filter(masses, lambda t: t[1] == k), -1)[2]
    mass = F.concat(F.lit("{"), F.array_join(F.transform(mass_types, lambda k: F.concat(V.quoted(k), F.lit(":"), V.raw_json(mass_last(k)))), ","), F.lit("}"))

    styles = lambda base, more=(): [base + s for s in ("", "/omp", "/gpu", "/kk", *more)]

    def fix(names: list[str]) -> Column:
        return F.try_element_at(F.filter("c_fix", lambda t: F.lower(F.get(t, F.lit(3))).isin(*names)), F.lit(1))

    def after(t: Column, word: str, n: int) -> Column:
        at = F.array_position(t, word).cast("int")
        return F.when((at > 0) & (F.size(t) >= at + 3), F.get(t, at + n - 1))

    kinds = ("iso", "aniso", "tri", "x", "y", "z")
    rows = V.computed(rows, **found, nvt=fix([*styles("nvt"), "langevin"]), npt=fix(styles("npt", ("/sphere", "/asphere"))), nve=fix(styles("nve", ("/sphere", "/asphere"))))
    places = F.filter(F.sequence(F.lit(0), F.size("npt") - 1), lambda i: F.get("npt", i).isin(*kinds) & (i + 3 < F.size("npt")))
    rows = V.computed(rows, _front=F.try_element_at(places, F.lit(1)), _back=F.try_element_at(places, F.lit(-1)))

    def thermostat(name: str, press: bool) -> dict[str, Column]:
        """The words of a fix, by what they say."""
        t = F.col(name)
        langevin = F.lower(F.get(t, F.lit(3))) == "langevin"
        put = lambda n: F.get(t, F.lit(3 + n))
        told = {
            "Tstart": F.when(langevin, put(1)).otherwise(after(t, "temp", 1)),
            "Tstop": F.when(langevin, put(2)).otherwise(after(t, "temp", 2)),
            "Tdamp": F.when(~langevin, after(t, "temp", 3)),
            "damp": F.when(langevin, put(3)),
        }
        if press:
            told |= {"Pstart": F.get(t, F.col("_back") + 1), "Pstop": F.get(t, F.col("_back") + 2), "Pdamp": F.get(t, F.col("_back") + 3)}
        return {f"{name}_{k}": v for k, v in told.items()}

    rows = V.computed(rows, **thermostat("nvt", False), **thermostat("npt", True))

    def fixed(name: str, press: bool) -> V.Field:
        raw = lambda k: V.raw_json(F.col(f"{name}_{k}"))
        pairs = {"style": V.quoted(F.lower(F.get(name, F.lit(3))))} | {k: raw(k) for k in ("Tstart", "Tstop", "Tdamp", "damp")}
        if press:
            pairs |= {"press_style": V.quoted(F.get(name, F.col("_front")))} | {k: raw(k) for k in ("Pstart", "Pstop", "Pdamp")}
        return V.json_field(F.when(F.col(name).isNotNull(), V.json_object(pairs)))

    numeric = lambda t, i: V.word_field(F.get(t, F.lit(i)))
    first_int = lambda name: F.try_element_at(F.filter(F.transform(_named(name), lambda t: F.try_element_at(F.filter(F.slice(t, 2, F.size(t)), lambda w: S.is_integer(w)), F.lit(1))), lambda w: w.isNotNull()), F.lit(1))
    dump = F.try_element_at(F.filter(F.transform(_named("dump", least=5), lambda t: F.get(t, F.lit(4))), lambda w: S.is_integer(w)), F.lit(1))
    seen = lambda *n: F.array_distinct(F.transform(_named(*n), lambda t: t[1]))
    listed = lambda a: V.json_field(F.when(F.size(a) > 0, F.to_json(a)))
    fields = {
        "units": V.string_field(last("units")[1]),
        "pair_style": V.string_field(F.when(last("pair_style").isNotNull(), rest(last("pair_style")))),
        "kspace_style": V.string_field(F.when(last("kspace_style").isNotNull(), rest(last("kspace_style")))),
        "timestep": numeric(last("timestep"), 1),
        "run": numeric(last("run"), 1),
        "minimize_etol": numeric(minimize, 1),
        "minimize_ftol": numeric(minimize, 2),
        "minimize_maxiter": numeric(minimize, 3),
        "minimize_maxeval": numeric(minimize, 4),
        "boundary": V.string_field(F.when(last("boundary").isNotNull(), F.array_join(F.slice(last("boundary"), 2, 3), " "))),
        "atom_style": V.string_field(last("atom_style")[1]),
        "dimension": numeric(last("dimension"), 1),
        "fix_nvt": fixed("nvt", False),
        "fix_npt": fixed("npt", True),
        "fix_nve": V.flag_field(F.when(F.col("nve").isNotNull(), F.lit(True))),
        "thermo": numeric(last("thermo"), 1),
        "pair_coeff": V.string_field(F.when(first("pair_coeff").isNotNull(), rest(first("pair_coeff")))),
        "neigh_modify": V.string_field(F.when(first("neigh_modify").isNotNull(), rest(first("neigh_modify")))),
        "read_data": listed(seen("read_data")),
        "variable_names": listed(seen("variable")),
        "mass": V.json_field(F.when(F.size(masses) > 0, mass)),
        "dump_interval": V.int_field(dump),
        "restart_interval": V.int_field(first_int("restart")),
    }
    return V.long_facts(rows, fields, F.when(F.size("c") == 0, "the script is empty"))


_NUM = r"([-+]?\d*\.?\d+(?:[eE][+-]?\d+)?)"
#: Counts and sections of a data file.
COUNTS = ("atoms", "atom types", "bonds", "bond types", "angles", "angle types", "dihedrals", "dihedral types", "impropers", "improper types")
SECTIONS = (
    "Atoms", "Velocities", "Masses", "Pair Coeffs", "PairIJ Coeffs", "Bond Coeffs", "Angle Coeffs", "Dihedral Coeffs", "Improper Coeffs", "Bonds", "Angles", "Dihedrals", "Impropers",
    "BondBond Coeffs", "BondAngle Coeffs", "AngleAngle Coeffs", "AngleTorsion Coeffs", "EndBondTorsion Coeffs", "MiddleBondTorsion Coeffs", "BondBond13 Coeffs", "AngleAngleTorsion Coeffs",
)


def parse_data(files: DataFrame) -> DataFrame:
    """Header of a data file and its masses; coordinates are never looked at beyond finding sections."""
    all_lines = lines_of(F.col("text"))
    title = F.try_element_at(F.filter(F.transform(all_lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), F.lit(1))
    body = F.slice(all_lines, 2, F.size(all_lines))
    name = r"(?i)^\s*(" + "|".join(s.replace(" ", r"\s+") for s in SECTIONS) + r")\s*(?:#.*)?$"
    body = F.transform(body, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    rows = V.computed(files, title=title, b=body)
    starts = F.transform(F.filter("b", lambda r: r["x"].rlike(name)), lambda r: F.struct(r["i"].alias("i"), F.regexp_replace(F.regexp_extract(r["x"], name, 1), r"\s+", " ").alias("s")))
    rows = V.computed(rows, starts=starts)
    top = F.coalesce(F.try_element_at("starts", F.lit(1))["i"], F.size("b"))
    mass_at = F.try_element_at(F.filter("starts", lambda r: F.lower(r["s"]) == "masses"), F.lit(-1))["i"]
    mass_end = F.coalesce(F.try_element_at(F.filter("starts", lambda r: r["i"] > mass_at), F.lit(1))["i"], F.size("b"))
    head = F.transform(F.slice("b", 1, F.greatest(top, F.lit(0))), lambda r: r["x"])
    mass_lines = F.when(mass_at.isNotNull(), F.transform(F.slice("b", mass_at + 2, F.greatest(mass_end - mass_at - 1, F.lit(0))), lambda r: F.regexp_replace(r["x"], "#.*$", "")))
    rows = V.computed(rows, h=head, sections=F.transform("starts", lambda r: r["s"]), masses=mass_lines).select("blob_hash", "title", "h", "sections", "masses")

    def line(pattern: str) -> Column:
        return F.try_element_at(F.filter("h", lambda x: x.rlike(pattern)), F.lit(-1))

    counted = r"(?i)^\s*(\d+)\s+(" + "|".join(what.replace(" ", r"\s+") for what in COUNTS) + r")\s*(?:#.*)?$"
    boxes = {axis: rf"(?i)^\s*{_NUM}\s+{_NUM}\s+{axis}lo\s+{axis}hi\s*(?:#.*)?$" for axis in "xyz"}
    tilt = rf"(?i)^\s*{_NUM}\s+{_NUM}\s+{_NUM}\s+xy\s+xz\s+yz\s*(?:#.*)?$"
    named = lambda x: F.struct(F.lower(F.regexp_replace(F.regexp_extract(x, counted, 2), r"\s+", " ")).alias("what"), F.regexp_extract(x, counted, 1).alias("n"))
    rows = V.computed(rows, _counts=F.transform(F.filter("h", lambda x: x.rlike(counted)), named), _tilt=line(tilt), **{f"_{axis}": line(p) for axis, p in boxes.items()})

    def count(what: str) -> Column:
        return F.try_element_at(F.filter("_counts", lambda c: c["what"] == what), F.lit(-1))["n"].try_cast("bigint")

    ends = {f"{axis}{end}": F.regexp_extract(f"_{axis}", p, i).try_cast("double") for axis, p in boxes.items() for i, end in enumerate(("lo", "hi"), 1)}
    rows = V.computed(rows, **ends, **{f"n_{i}": count(what) for i, what in enumerate(COUNTS)})
    rows = V.computed(rows, **{f"l{axis}": F.round(F.col(f"{axis}hi") - F.col(f"{axis}lo"), 10) for axis in "xyz"})
    number = {what: F.col(f"n_{i}") for i, what in enumerate(COUNTS)}
    fields = {"title": V.string_field(F.col("title"))} | {"num_" + what.replace(" ", "_"): V.int_field(n.cast("string")) for what, n in number.items()}
    sides = [F.col(f"l{axis}") for axis in "xyz"]
    for axis in "xyz":
        fields |= {k: V.real_field(F.col(k)) for k in (f"{axis}lo", f"{axis}hi", f"l{axis}")}
    fields |= {t: V.real_field(F.regexp_extract("_tilt", tilt, i).try_cast("double")) for i, t in enumerate(("xy", "xz", "yz"), 1)}
    fields["volume"] = V.real_field(F.round(sides[0] * sides[1] * sides[2], 6))
    fields["has_bonds"] = V.flag_field(F.coalesce(number["bonds"] > 0, F.lit(False)))
    fields["sections"] = V.json_field(F.to_json("sections"))
    entry = F.filter(F.transform("masses", S.words), lambda w: (F.size(w) >= 2) & S.is_integer(F.get(w, F.lit(0))) & S.as_number(F.get(w, F.lit(1))).isNotNull())
    ordered = F.array_sort(F.transform(entry, lambda w: F.struct(w[0].try_cast("bigint").alias("t"), S.as_number(w[1]).alias("m"))))
    masses = F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda r: F.concat(F.lit('"'), r["t"].cast("string"), F.lit('":'), r["m"].cast("string"))), ","), F.lit("}"))
    fields["masses"] = V.json_field(F.when(F.size(entry) > 0, masses))
    return V.long_facts(rows, fields, F.when(number["atoms"].isNull(), "no number of atoms"))


#: Columns of the thermo table and their facts.
THERMO = {"Step": "final_step", "Temp": "final_temp", "Press": "final_press", "TotEng": "final_etotal", "KinEng": "final_ke"}
_HEADER = r"^\s*Step(\s+[\w./]+)+\s*$"
_STATE = "struct<head:array<string>,step:double,row:array<string>,names:array<string>,run:double>"


def _state(head: Column, step: Column, row: Column, names: Column, run: Column) -> Column:
    return F.struct(head.alias("head"), step.alias("step"), row.alias("row"), names.alias("names"), run.alias("run")).cast(_STATE)


def empty_state() -> Column:
    none = F.lit(None).cast("array<string>")
    return _state(none, F.lit(None).cast("double"), none, none, F.lit(0.0))


def all_numbers(cells: Column) -> Column:
    return F.forall(cells, lambda c: S.as_number(c).isNotNull())


def step_of(cells: Column, head: Column) -> Column:
    return S.as_number(F.get(cells, F.array_position(head, "Step").cast("int") - 1))


def next_state(state: Column, x: Column) -> Column:
    """The state after a line: a block starts at a header and ends at the first line that is neither blank nor a row of the header's width."""
    cells, none = x["cells"], F.lit(None)
    fits = state["head"].isNotNull() & (F.size(cells) == F.size(state["head"])) & all_numbers(cells)
    step = step_of(cells, state["head"])
    return (
        F.when(x["head"].isNotNull(), _state(x["head"], none, state["row"], state["names"], state["run"]))
        .when(x["blank"], state)
        .when(fits, _state(state["head"], step, cells, state["head"], state["run"] + F.coalesce(step - state["step"], F.lit(0.0))))
        .otherwise(_state(none, none, state["row"], state["names"], state["run"]))
    )


def thermo_state(rows: Column) -> Column:
    """Fold of a log's lines (struct<head,cells,blank>): the last row with its names, and the steps run.

    Steps run are summed row by row, which equals last minus first of each
    block.
    """
    return F.aggregate(rows, empty_state(), next_state)


def yaml_line(x: Column) -> Column:
    """A line as part of a YAML table."""
    inner = F.split(F.regexp_replace(F.regexp_extract(x, r"\[(.*?),?\s*\]", 1), "['\" ]", ""), ",")
    return F.struct(F.when(x.rlike(r"^\s*keywords:\s*\["), inner).alias("head"), F.when(x.rlike(r"^\s*-\s*\["), inner).otherwise(F.array(F.lit("x"))).alias("cells"), F.trim(x).isin("", "data:").alias("blank"))


def column_line(x: Column) -> Column:
    """A line as part of a table of columns."""
    return F.struct(F.when(x.rlike(_HEADER), S.words(x)).otherwise(F.lit(None).cast("array<string>")).alias("head"), S.words(x).alias("cells"), (F.trim(x) == "").alias("blank"))


#: What is looked for where there is no table, the last match of each; and the first match of the rest.
LAST_VALUES = {"last_etotal": r"(?:TotEng|E_total)\s+([-+]?\d+\.\d+)", "last_temp": r"Temp\s+([\d.]+)"}
FIRST_VALUES = {"first_atoms": r"(?m)(\d+)\s+atoms$", "first_wall": r"Total wall time:\s*(\S+)"}


def single_values(text: Column) -> dict[str, Column]:
    return {k: S.last_match(text, p) for k, p in LAST_VALUES.items()} | {k: S.first_match(text, p) for k, p in FIRST_VALUES.items()}


def parse_log(files: DataFrame) -> DataFrame:
    """The end of a run from its log: YAML tables, else column tables, else single values; broken logs give what they have."""
    text = F.coalesce("text", F.lit(""))
    lines = lines_of(text)
    # a YAML table has this word in its head; columns count only where there is none
    yaml = F.when(text.contains("keywords:"), thermo_state(F.transform(lines, yaml_line)))
    rows = V.computed(files.select("blob_hash", text.alias("text")), y=yaml, **single_values(text))
    rows = V.computed(rows, c=F.when(F.col("y.row").isNull(), thermo_state(F.transform(lines_of(F.col("text")), column_line))))
    return log_facts(rows)


def log_facts(rows: DataFrame) -> DataFrame:
    """Facts of logs (blob_hash, states y of the YAML and c of the column tables, single values)."""
    rows = V.computed(rows, t=F.when(F.col("y.row").isNotNull(), F.col("y")).when(F.col("c.row").isNotNull(), F.col("c")))

    def column(name: str) -> Column:
        at = F.array_position("t.names", name).cast("int")
        return S.as_number(F.when(at > 0, F.get(F.col("t.row"), at - 1)))

    no_table, wall = F.col("t").isNull(), F.col("first_wall")
    fields = {fact: V.int_field(column(name).cast("bigint").cast("string")) if fact == "final_step" else V.real_field(column(name)) for name, fact in THERMO.items()}
    single = lambda name, last: V.real_field(F.coalesce(column(name), F.when(no_table, S.as_number(F.col(last)))))
    fields |= {"final_pe": V.real_field(F.coalesce(column("PotEng"), column("E_pair"))), "final_etotal": single("TotEng", "last_etotal"), "final_temp": single("Temp", "last_temp")}
    fields |= {
        "run_steps": V.int_field(F.when(F.col("t.run") > 0, F.col("t.run").cast("bigint").cast("string"))),
        "num_atoms": V.int_field(F.col("first_atoms")),
        "wall_time": V.string_field(wall),
        "completed": V.flag_field(wall.isNotNull()),
        "thermo_keywords": V.json_field(F.when(F.col("t.names").isNotNull(), F.to_json("t.names"))),
    }
    return V.long_facts(rows, fields)
