"""Validation of simulation files: rules on the facts of one file, and rules across the files of a directory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..parsers import registry
from ..parsers.dft import incar_entries, incar_unreadable, incar_value, kpoints_unreadable, lines_of
from ..parsers.values import ERROR, computed
from .validate import Rule, apply_rules, messages, told, with_messages


#: Rules of further types: functions of a look-up (name -> struct<kind,num,value>) that give rules, by type.
TYPE_RULES: dict[str, Callable[[Callable[[str], Column]], list[Rule]]] = {}


def _fact_rules(types: list[str] | None = None) -> tuple[dict[str, list[Rule]], Rule, set[str]]:
    """Rules of these types, or of all, by type; the rule that silences them; and the facts that they look at."""
    names: set[str] = set()

    def fact(name: str) -> Column:
        names.add(name)
        return F.try_element_at("f", F.lit(name))

    num, kind, value = (lambda n: fact(n)["num"]), (lambda n: fact(n)["kind"]), (lambda n: fact(n)["value"])
    numeric = lambda n: kind(n).isin("int", "double")
    whole = lambda n: kind(n) == "int"
    absent = lambda n: fact(n).isNull()
    parse = Rule("parse", "error", ~absent(ERROR), F.concat(F.lit("cannot be parsed: "), value(ERROR)))
    rules = [
        ("INCAR", Rule("V1", "error", numeric("ENCUT") & (num("ENCUT") <= 0), "ENCUT must be positive")),
        ("INCAR", Rule("V2", "error", whole("ISMEAR") & ~num("ISMEAR").between(-5, 5), "ISMEAR must be from -5 to 5")),
        ("INCAR", Rule("V3", "error", numeric("SIGMA") & (num("SIGMA") <= 0), "SIGMA must be positive")),
        ("INCAR", Rule("V4", "error", whole("NSW") & (num("NSW") < 0), "NSW must not be negative")),
        ("INCAR", Rule("V5", "error", (num("ISMEAR") == 0) & (num("SIGMA") > 0.2), "SIGMA over 0.2 is too wide for ISMEAR 0")),
        ("OUTCAR", Rule("V6", "error", (num("is_stopped") == 1) | absent("final_energy"), "the run stopped or has no final energy")),
        ("LAMMPS_INPUT", Rule("V7a", "error", absent("units"), "units are missing")),
        ("LAMMPS_INPUT", Rule("V7b", "error", absent("pair_style"), "pair_style is missing")),
        ("LAMMPS_INPUT", Rule("V7c", "error", numeric("timestep") & (num("timestep") <= 0), "timestep must be positive")),
        ("LAMMPS_DATA", Rule("V8a", "error", F.coalesce(num("num_atoms"), F.lit(0.0)) <= 0, "there must be atoms")),
        ("LAMMPS_DATA", Rule("V8b", "error", num("num_atom_types") <= 0, "there must be atom types")),
        ("LAMMPS_LOG", Rule("V9a", "error", num("completed") == 0, "the run did not complete")),
        ("LAMMPS_LOG", Rule("V9b", "error", num("num_atoms") <= 0, "there must be atoms")),
        ("ORCA_INPUT", Rule("V10a", "error", absent("keywords") | (value("keywords") == "[]"), "keywords are missing")),
        ("ORCA_INPUT", Rule("V10b", "error", absent("charge"), "the charge is missing")),
        ("ORCA_INPUT", Rule("V10c", "error", num("multiplicity") < 1, "the multiplicity must be at least 1")),
        ("ORCA_OUTPUT", Rule("V11a", "error", ~F.coalesce(value("termination_status") == '"normal"', F.lit(False)), "the run did not end normally")),
        ("ORCA_OUTPUT", Rule("V11b", "error", absent("final_energy"), "there is no final energy")),
        ("ORCA_OUTPUT", Rule("V11c", "error", num("optimization_converged") == 0, "the optimization did not converge")),
    ]
    rules += [("LAMMPS_DATA", Rule(f"V8{side}", "error", num(side) <= 0, f"{side} must be positive")) for side in ("lx", "ly", "lz")]
    rules += [(kind, r) for kind, own in TYPE_RULES.items() for r in own(fact)]
    by_type: dict[str, list[Rule]] = {}
    for kind, r in rules:
        if types is None or kind in types:
            by_type.setdefault(kind, []).append(r)
    return by_type, parse, names


def validate(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(file, file_type, passed, errors, warnings) of files (file, file_type, blob_hash, text); unknown types pass.

    ``types`` names the types that occur, if they are known: only their
    parsers are planned.
    """
    by_type, parse, names = _fact_rules(types)
    parsed = registry.facts_of(files, types).where(F.col("path").isin(*names))
    entry = F.struct("path", F.struct("kind", "num", "value"))
    maps = parsed.groupBy("blob_hash", "file_type").agg(F.map_from_entries(F.collect_list(entry)).alias("f"))
    rows = files.select("file", "file_type", "blob_hash").join(maps.hint("merge"), ["blob_hash", "file_type"], "left")

    def own(level: str) -> Column:
        """A row meets the rules of its type only; what cannot be parsed meets none."""
        out = F.when(parse.broken, messages([parse], level))
        for kind, rules in by_type.items():
            out = out.when(F.col("file_type") == kind, messages(rules, level))
        return out.otherwise(F.array().cast("array<string>"))

    return with_messages(rows, own("error"), own("warning")).select("file", "file_type", "passed", "errors", "warnings")


@dataclass(frozen=True)
class Validator:
    """A cross-file rule set: runs where ``applies`` holds, over one row a directory with a text column for each name."""

    name: str
    priority: int
    enabled: bool
    applies: Callable[[], Column]
    rules: Callable[[], list[Rule]] | None = None
    #: Instead of rules: from the texts of a directory by name to its errors and warnings, called in the tasks.
    check: Callable[[dict[str, str | None]], tuple[list[str], list[str]]] | None = None
    #: Adds columns that the rules share, so that they are computed once a directory.
    prepare: Callable[[DataFrame], DataFrame] | None = None


def _content(text: Column) -> Column:
    return F.filter(lines_of(text), lambda x: F.trim(x) != "")


def _elements(lines: Column) -> Column:
    return S.words(F.get(lines, F.lit(5)))


def _counts(lines: Column) -> Column:
    """Atom counts; null unless all are whole numbers."""
    n = F.transform(S.words(F.get(lines, F.lit(6))), lambda w: F.when(S.is_integer(w), w.try_cast("bigint")))
    return F.when((F.size(n) > 0) & F.forall(n, lambda x: x.isNotNull()), n)


def _with_poscar(wide: DataFrame) -> DataFrame:
    """Adds the POSCAR's lines, elements, counts and atoms, and whether elements and counts are where they belong."""
    if "_poscar" in wide.columns:
        return wide
    rows = computed(wide, _lines=_content(F.col("POSCAR")))
    rows = computed(rows, _elements=_elements(F.col("_lines")), _counts=_counts(F.col("_lines")))
    atoms = F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    readable = F.coalesce(F.col("_counts").isNotNull() & (F.size("_lines") >= 8), F.lit(False))
    return computed(rows, _poscar=F.struct("_lines", "_elements", "_counts", atoms.alias("atoms"), readable.alias("readable"))).drop("_lines", "_elements", "_counts")


def _with_elements(wide: DataFrame) -> DataFrame:
    """Adds the elements of both files and where they differ."""
    rows = computed(_with_poscar(wide), _potcar=potcar_elements(F.col("POTCAR")))
    a, b = F.col("_poscar._elements"), F.col("_potcar")
    places = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: F.when(z["a"].isNotNull() & z["b"].isNotNull() & (z["a"] != z["b"]), F.concat((i + 1).cast("string"), F.lit(": "), z["a"], F.lit(" vs "), z["b"]))), lambda m: m.isNotNull())
    return computed(rows, _missing=F.array_except(a, b), _extra=F.array_except(b, a), _places=places)


#: Tags of an INCAR that are checked against the POSCAR.
LISTS, NUMBERS = ("MAGMOM", "LDAUU", "LDAUJ", "LDAUL"), ("ISPIN", "NSW", "ISIF")


def _with_incar(wide: DataFrame) -> DataFrame:
    """Adds the INCAR's raw values, the lengths of its lists and its numbers, and whether it can be read."""
    rows = computed(_with_poscar(wide), _entries=incar_entries(F.col("INCAR")))
    raw = lambda tag: F.try_element_at(F.filter("_entries", lambda x: x["tag"] == tag), F.lit(-1))["raw"]
    told = ~F.coalesce(incar_unreadable(F.col("INCAR"), F.col("_entries")), F.lit(True))
    rows = computed(rows, _told=told, _raw=F.struct(*(raw(t).alias(t) for t in (*LISTS, *NUMBERS)))).drop("_entries")
    sizes = F.struct(*(F.size(S.expanded(F.col(f"_raw.{t}"))).alias(t) for t in LISTS))
    numbers = F.struct(*(incar_value(F.lit(t), F.col(f"_raw.{t}"))["num"].alias(t) for t in NUMBERS))
    return computed(rows, _size=sizes, _number=numbers)


def potcar_elements(text: Column) -> Column:
    """Elements of the TITEL lines, suffixes such as ``_sv`` cut off."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"TITEL\s*=\s*\S+\s+(\S+)"), F.lit(1))
    return F.transform(found, lambda x: F.substring_index(x, "_", 1))


def _poscar_potcar() -> list[Rule]:
    a, b, readable = F.col("_poscar._elements"), F.col("_potcar"), F.col("_poscar.readable")
    there = F.col("POSCAR").isNotNull() & F.col("POTCAR").isNotNull()
    both = there & readable
    missing, extra, places = F.col("_missing"), F.col("_extra"), F.col("_places")
    differ = both & ~a.eqNullSafe(b)
    return [
        Rule("V12", "warning", F.col("POTCAR").isNull(), "POTCAR is missing"),
        Rule("V12", "error", there & ~both, "POSCAR cannot be read"),
        Rule("V12", "error", differ & (F.size(missing) > 0), F.concat(F.lit("not in POTCAR: "), F.array_join(missing, ", "))),
        Rule("V12", "error", differ & (F.size(extra) > 0), F.concat(F.lit("not in POSCAR: "), F.array_join(extra, ", "))),
        Rule("V12", "error", differ & (F.size(places) > 0), F.concat(F.lit("order differs at "), F.array_join(places, ", "))),
        Rule("V12", "error", differ & (F.size(missing) == 0) & (F.size(extra) == 0) & (F.size(places) == 0), "numbers of elements differ"),
    ]


def _incar_poscar() -> list[Rule]:
    raw, number = (lambda tag: F.col(f"_raw.{tag}")), (lambda tag: F.col(f"_number.{tag}"))
    species, atoms, told = F.size("_poscar._elements"), F.col("_poscar.atoms"), F.col("_told")
    readable = F.col("_poscar.readable") & told
    moments = F.col("_size.MAGMOM")
    rules = [
        Rule("V19", "warning", ~F.col("_poscar.readable"), "POSCAR cannot be read, checks skipped"),
        Rule("V19", "warning", ~told, "INCAR cannot be read, checks skipped"),
        Rule("V13", "error", readable & raw("MAGMOM").isNotNull() & (moments != atoms), F.concat(F.lit("MAGMOM has "), moments.cast("string"), F.lit(" values for "), atoms.cast("string"), F.lit(" atoms"))),
        Rule("V15", "warning", readable & (number("ISPIN") == 2) & raw("MAGMOM").isNull(), "ISPIN = 2 without MAGMOM"),
        Rule("V16", "warning", readable & (F.coalesce(number("NSW"), F.lit(0.0)) == 0) & S.is_integer(raw("ISIF")) & (number("ISIF") >= 3), "NSW = 0 makes ISIF of 3 or more useless"),
    ]
    for tag in ("LDAUU", "LDAUJ", "LDAUL"):
        n = F.col(f"_size.{tag}")
        rules.append(Rule("V14", "error", readable & (n > 1) & (n != species), F.concat(F.lit(f"{tag} has "), n.cast("string"), F.lit(" values for "), species.cast("string"), F.lit(" species"))))
    return rules


def _file_format() -> list[Rule]:
    c = F.col("_poscar._lines")
    line = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    there = F.col("POSCAR").isNotNull()
    long_enough = there & (F.size(c) >= 8)
    scale = S.as_number(F.get(S.words(line(1)), F.lit(0)))
    lattice = F.exists(F.slice(c, 3, 3), lambda x: ~((F.size(S.words(x)) >= 3) & F.forall(F.slice(S.words(x), 1, 3), lambda w: S.as_number(w).isNotNull())))
    elements, count_words = S.words(line(5)), S.words(line(6))
    counts = F.col("_poscar._counts")
    mode_at = F.when(F.upper(F.substring(line(7), 1, 1)) == "S", 8).otherwise(7)
    mode = F.upper(F.substring(F.trim(F.coalesce(F.get(c, mode_at), F.lit(""))), 1, 1))
    atoms = F.col("_poscar.atoms")
    rows = F.size(c) - mode_at - 1
    return [
        Rule("V17", "error", there & (F.size(c) < 8), "POSCAR has fewer than 8 lines"),
        Rule("V17", "error", long_enough & (scale.isNull() | (scale == 0)), "POSCAR: the scale must be a number other than zero"),
        Rule("V17", "error", long_enough & lattice, "POSCAR: lattice rows need three numbers"),
        Rule("V17", "error", long_enough & F.forall(elements, lambda w: w.rlike(r"^-*\d+$")), "POSCAR: the line of elements has numbers"),
        Rule("V17", "error", long_enough & (counts.isNull() | F.exists(counts, lambda x: x < 0)), "POSCAR: counts must be whole and not negative"),
        Rule("V17", "error", long_enough & (F.size(elements) != F.size(count_words)), "POSCAR: numbers of elements and counts differ"),
        Rule("V17", "error", long_enough & ~mode.isin("C", "D", "K"), "POSCAR: the coordinate mode must be C, D or K"),
        Rule("V17", "error", long_enough & counts.isNotNull() & (rows < atoms), "POSCAR: coordinate rows are missing"),
        Rule("V18", "error", F.col("bad_inputs") != "", F.col("bad_inputs")),
    ]


def _has(*names: str) -> Callable[[], Column]:
    return lambda: F.size(F.array_intersect("names", F.array(*map(F.lit, names)))) == len(names)


VALIDATORS: dict[str, Validator] = {
    v.name: v
    for v in (
        Validator("file-format", 5, False, lambda: F.arrays_overlap("names", F.array(*map(F.lit, ("INCAR", "KPOINTS", "POSCAR")))), _file_format, prepare=_with_poscar),
        Validator("poscar-potcar", 10, True, lambda: F.array_contains("names", "POSCAR"), _poscar_potcar, prepare=_with_elements),
        Validator("incar-poscar", 20, True, _has("INCAR", "POSCAR"), _incar_poscar, prepare=_with_incar),
    )
}


def register(validator: Validator) -> None:
    """A further rule set, or another one of the same name."""
    VALIDATORS[validator.name] = validator


def enabled_validators(config: dict[str, bool] | None = None) -> list[Validator]:
    """In ascending priority, equal ones in order of registration; a configured choice overrides the default."""
    config = config or {}
    return sorted((v for v in VALIDATORS.values() if config.get(v.name, v.enabled)), key=lambda v: v.priority)


_RESULT = "dir string, rule string, priority int, passed boolean, message string, errors array<string>, warnings array<string>"


def directories(files: DataFrame, inputs: bool = True) -> DataFrame:
    """One row a directory of files (path, text): dir, names, a text column for each named file, bad_inputs (left out without ``inputs``).

    INCAR and KPOINTS are looked at in the row of their directory's file, so
    no text is shuffled for that.
    """
    name = F.upper(S.basename(F.col("path")))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    rows = files.select(folder.alias("dir"), name.alias("name"), "text").where(F.col("name").isin(*NAMED))
    wide = rows.groupBy("dir").agg(F.collect_set("name").alias("names"), *(F.max(F.when(F.col("name") == n, F.col("text"))).alias(n) for n in NAMED))
    if not inputs:
        return wide
    own = lambda n: rows.where(F.col("name") == n).select("dir", "text")
    incar = computed(own("INCAR"), e=incar_entries(F.col("text"))).where(incar_unreadable(F.col("text"), F.col("e")))
    bad = incar.select("dir", F.lit("INCAR").alias("name")).unionByName(kpoints_unreadable(own("KPOINTS")).select("dir", F.lit("KPOINTS").alias("name")))
    bad = bad.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set(F.concat("name", F.lit(" cannot be parsed")))), "; ").alias("bad_inputs"))
    return wide.join(bad.hint("merge"), "dir", "left").withColumn("bad_inputs", F.coalesce("bad_inputs", F.lit("")))


NAMED = ("POSCAR", "POTCAR", "INCAR", "KPOINTS")


def _checked(wide: DataFrame, check: Callable) -> DataFrame:
    """passed, errors and warnings by a Python check of each directory; one that raises is an error of its directory alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    errors, warnings = check({n: row[n] for n in NAMED})
                    out.append((row["dir"], [str(e) for e in errors], [str(w) for w in warnings], None))
                except Exception as e:  # whatever a check of someone else raises
                    out.append((row["dir"], [f"{type(e).__name__}: {e}"], [], f"{type(e).__name__}: {e}"))
            if out:
                kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["dir", "errors", "warnings", "crash"])

    rows = wide.select("dir", *NAMED).mapInArrow(run, "dir string, errors array<string>, warnings array<string>, crash string")
    return rows.withColumn("passed", F.size("errors") == 0)


def _summary() -> Column:
    return F.when(F.col("passed"), "ok").otherwise(F.concat(F.size("errors").cast("string"), F.lit(" problem(s)")))


def judged_together(wide: DataFrame, validators: list[Validator]) -> DataFrame:
    """Results of several validators by rules from one pass over the directories."""
    keep = wide.columns
    rows, results = wide, []
    for i, v in enumerate(validators):
        rows = v.prepare(rows) if v.prepare else rows
        rules = v.rules()
        found = F.struct(F.lit(v.name).alias("rule"), F.lit(v.priority).alias("priority"), messages(rules, "error").alias("errors"), messages(rules, "warning").alias("warnings"))
        rows = computed(rows, **{f"_result{i}": F.when(v.applies(), found)})
        results.append(f"_result{i}")
        keep = [*wide.columns, *results, *(["_poscar"] if "_poscar" in rows.columns else [])]
        rows = rows.select(*keep)
    rows = rows.select("dir", F.explode(F.array(*results)).alias("r")).where("r is not null")
    rows = rows.select("dir", "r.rule", "r.priority", told(F.col("r.errors")).alias("errors"), told(F.col("r.warnings")).alias("warnings"))
    rows = rows.withColumn("passed", F.size("errors") == 0)
    return rows.select("dir", "rule", "priority", "passed", _summary().alias("message"), "errors", "warnings")


def judged(wide: DataFrame, validator: Validator) -> DataFrame:
    """Results of one validator in the directories to which it applies."""
    own = wide.where(validator.applies())
    if validator.check:
        found = _checked(own, validator.check)
    else:
        own = validator.prepare(own) if validator.prepare else own
        found = apply_rules(own, validator.rules()).withColumn("crash", F.lit(None).cast("string"))
    message = F.when(F.col("crash").isNotNull(), F.concat(F.lit("the validator failed: "), "crash")).otherwise(_summary())
    return found.select("dir", F.lit(validator.name).alias("rule"), F.lit(validator.priority).alias("priority"), "passed", message.alias("message"), "errors", "warnings")


def crashed(wide: DataFrame, validator: Validator, problem: Exception) -> DataFrame:
    """A failed result of each directory for a validator that cannot run."""
    text = next((x.strip() for x in str(problem).splitlines() if x.strip()), type(problem).__name__)
    return wide.select("dir", F.lit(validator.name).alias("rule"), F.lit(validator.priority).alias("priority"), F.lit(False).alias("passed"), F.lit(f"the validator failed: {text}").alias("message"), F.array(F.lit(text)).alias("errors"), F.array().cast("array<string>").alias("warnings"))


def _runs(df: DataFrame) -> Exception | None:
    """Whether a plan comes to its end: the exception if not."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception as e:  # whatever a rule set of someone else raises
        return e
    return None


#: Parts into which directories are divided in search of those whose rules raise.
PARTS = 8


def held_apart(wide: DataFrame, validator: Validator, depth: int = 0) -> DataFrame:
    """Results of a validator whose rules may raise at run time: failed in the directories in which they do, and as usual in all others.

    The directories are divided by a hash until a part runs or is a single
    one, which takes some ``PARTS`` jobs for each level and directory that
    raises. A Python check needs none of this: it is held apart row by row.
    """
    try:
        told = judged(wide, validator)
    except Exception as e:
        return crashed(wide, validator, e)
    problem = _runs(told)
    if problem is None:
        return told
    if wide.limit(2).count() < 2 or depth > 21:  # 64 bits of hash are used up
        return crashed(wide, validator, problem)
    out = None
    for i in range(PARTS):
        own = held_apart(wide.where(F.pmod(F.shiftright(F.xxhash64("dir"), 3 * depth), F.lit(PARTS)) == i), validator, depth + 1)
        out = own if out is None else out.unionByName(own)
    return out


def run_validators(files: DataFrame, config: dict[str, bool] | None = None, isolate: bool = False, chosen: list[Validator] | None = None) -> DataFrame:
    """(dir, rule, priority, passed, message, errors, warnings) for each directory of files (path, text) and validator that applies.

    One pass brings the named files of a directory into one row; a validator
    is a projection of that row. One whose rules cannot be planned is a failed
    result of every directory, and the others still run. With ``isolate`` the
    plan is run once before it is given back; if it fails, each validator is
    run by itself, and one that raises fails only in the directories in which
    it does (see ``held_apart``). Nothing is kept in memory.
    """
    validators = enabled_validators(config) if chosen is None else chosen
    wide = directories(files, any(v.check is None and v.rules not in (_poscar_potcar, _incar_poscar) for v in validators))
    if validators and not isolate and all(v.check is None for v in validators):
        try:
            return judged_together(wide, validators)
        except Exception:  # one of them cannot be planned: each by itself
            pass
    each = []
    for v in validators:
        try:
            each.append(judged(wide, v))
        except Exception as e:  # whatever a rule set of someone else raises
            each.append(crashed(wide, v, e))
    if isolate and each and _runs(_united(each)) is not None:
        each = [held_apart(wide, v) for v in validators]
    return _united(each) if each else files.sparkSession.createDataFrame([], _RESULT)


def _united(each: list[DataFrame]) -> DataFrame:
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out
