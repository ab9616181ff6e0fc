"""Plane-wave DFT files: INCAR, KPOINTS and OUTCAR as facts. One projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import values as V


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def incar_entries(text: Column) -> Column:
    """Array of struct<tag,raw>, in order: ``;`` separates, ``#`` starts a comment, ``!`` only at the start of a line."""
    rows = F.filter(lines_of(text), lambda x: ~F.trim(x).startswith("!"))
    parts = F.flatten(F.transform(rows, lambda x: F.split(F.regexp_replace(x, "#.*$", ""), ";")))
    pattern = r"^\s*(\w+)\s*=\s*(.*?)\s*$"
    return F.transform(F.filter(parts, lambda p: p.rlike(pattern)), lambda p: F.struct(F.upper(F.regexp_extract(p, pattern, 1)).alias("tag"), F.regexp_extract(p, pattern, 2).alias("raw")))


def incar_unreadable(text: Column, entries: Column) -> Column:
    """Whether there is text, comments and blank lines aside, but no ``tag = value``."""
    told = F.exists(lines_of(text), lambda x: ~F.trim(F.regexp_replace(x, "[#!].*$", "")).isin(""))
    return (F.size(entries) == 0) & told


def incar_value(tag: Column, raw: Column) -> Column:
    """Typed: truth value, integer, real, list of numbers (``2*0.6`` expanded), else text."""
    up = F.upper(raw)
    numbers = S.expanded(raw)
    many = ((F.size(S.words(raw)) > 1) | raw.contains("*")) & numbers.isNotNull()
    flag = F.when(up.isin(".TRUE.", "T", ".T."), F.lit(True)).when(up.isin(".FALSE.", "F", ".F."), F.lit(False))
    return F.when(tag == "SYSTEM", V.string(raw)).when(flag.isNotNull(), V.truth(flag)).when(many, V.json(F.to_json(numbers))).otherwise(V.number_or_text(raw))


def parse_incar(files: DataFrame) -> DataFrame:
    """One fact a tag; the last of a repeated tag counts. Text without a single tag, comments aside, is an error.

    The entries of a file are sorted by tag and place, so that the last of a
    tag is the one before another tag; they become rows before their values
    are typed, which keeps that in generated code.
    """
    placed = F.transform(incar_entries(F.col("text")), lambda x, i: F.struct(x["tag"].alias("path"), i.alias("at"), x["raw"].alias("raw")))
    rows = V.computed(files.select("blob_hash", "text"), e=F.array_sort(placed))
    last = F.filter("e", lambda x, i: ~F.get("e", i + 1)["path"].eqNullSafe(x["path"]))
    failed = F.array(F.struct(F.lit(V.ERROR).alias("path"), F.lit(0).alias("at"), F.lit("no tags").alias("raw")))
    rows = rows.select("blob_hash", F.inline(F.when(incar_unreadable(F.col("text"), F.col("e")), failed).otherwise(last)))
    typed = F.when(F.col("path") == V.ERROR, V.string(F.col("raw"))).otherwise(incar_value(F.col("path"), F.col("raw")))
    return V.computed(rows.select("blob_hash", "path", "raw"), v=typed).select("blob_hash", "path", "v.*").where("kind is not null")


def _triple(text: Column, kind: str) -> Column:
    """The first three words as numbers; null unless all are numeric."""
    w = F.slice(S.words(text), 1, 3)
    n = F.transform(w, S.as_number)
    return F.when((F.size(w) == 3) & F.forall(n, lambda x: x.isNotNull()), n.cast(f"array<{kind}>"))


def _kpoints(files: DataFrame) -> tuple[DataFrame, Column, dict[str, V.Field]]:
    """Rows with their lines, what is wrong with them, and their facts."""
    line = F.transform(lines_of(F.col("text")), lambda x: F.trim(x))
    rows = V.computed(files, l=line)
    at = lambda i: F.get("l", F.lit(i))
    rest = F.filter(F.slice("l", 4, F.size("l")), lambda x: x != "")
    tail = F.filter(F.slice("l", 5, F.size("l")), lambda x: x != "")
    rows = V.computed(
        rows,
        comment=at(0),
        n=F.regexp_extract(F.coalesce(at(1), F.lit("")), r"^\s*(-?\d+)", 1).try_cast("int"),
        style=F.upper(F.substring(F.coalesce(at(2), F.lit("")), 1, 1)),
        rest=rest,
        tail=tail,
    )
    automatic, line_mode = F.col("n") == 0, F.col("style") == "L"
    grid = _triple(F.coalesce(at(3), F.lit("")), "bigint")
    shift = F.coalesce(_triple(F.coalesce(at(4), F.lit("")), "double"), F.array(*[F.lit(0.0)] * 3))
    point = lambda x: F.struct(_triple(x, "double").alias("coords"), F.coalesce(S.as_number(F.get(S.words(x), F.lit(3))), F.lit(1.0)).alias("weight"))
    points = F.transform(F.slice("rest", 1, F.greatest("n", F.lit(0))), point)
    stop = lambda x: F.struct(_triple(F.regexp_replace(x, "!.*$", ""), "double").alias("coords"), F.coalesce(F.trim(F.regexp_extract(x, r"!\s*(.*)$", 1)), F.lit("")).alias("label"))
    stops = F.transform("tail", stop)
    pairs = F.floor(F.size("tail") / 2).cast("int")
    segments = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), lambda i: F.struct(F.get(stops, i * 2).alias("start"), F.get(stops, i * 2 + 1).alias("end"))))
    kind = F.when(automatic, "automatic").when(line_mode, "line").otherwise("explicit")
    only = lambda k, f: (f[0], F.when(kind == k, f[1]))
    bad = (
        F.when(F.size(F.filter("l", lambda x: x != "")) < 4, "too few lines").when(F.col("n").isNull(), "no number of points").when(automatic & grid.isNull(), "the grid is not numeric")
        .when((kind == "explicit") & ((F.size("rest") < F.col("n")) | F.exists(points, lambda p: p["coords"].isNull())), "points are missing or not numeric")
        .when((kind == "line") & F.exists(stops, lambda p: p["coords"].isNull()), "points are not numeric")
    )
    fields = {
        "type": V.string_field(kind),
        "comment": V.string_field(F.col("comment")),
        "gamma_centered": only("automatic", V.flag_field(F.col("style") == "G")),
        "grid": only("automatic", V.json_field(F.to_json(grid))),
        "shift": only("automatic", V.json_field(F.to_json(shift))),
        "num_kpoints": only("explicit", V.int_field(F.col("n").cast("string"))),
        "cartesian": only("explicit", V.flag_field(F.col("style").isin("C", "K"))),
        "kpoints": only("explicit", V.json_field(F.to_json(points))),
        "num_points": only("line", V.int_field(F.col("n").cast("string"))),
        "reciprocal": only("line", V.flag_field(F.upper(F.substring(at(3), 1, 1)) == "R")),
        "num_segments": only("line", V.int_field(pairs.cast("string"))),
        "segments": only("line", V.json_field(F.to_json(segments))),
    }
    return rows, bad, fields


def parse_kpoints(files: DataFrame) -> DataFrame:
    """Grids, explicit points and line mode; too few lines or a grid that is not numeric is an error."""
    rows, bad, fields = _kpoints(files)
    return V.long_facts(rows, fields, bad)


def kpoints_unreadable(files: DataFrame) -> DataFrame:
    """Those of the files (with a column text) that are an error."""
    rows, bad, _ = _kpoints(files)
    return rows.where(bad.isNotNull()).select(*files.columns)


#: Patterns of the output file, first match each.
OUTCAR_PATTERNS = {
    "final_energy": r"free\s+energy\s+TOTEN\s*=\s*([-\d.]+)\s*eV",
    "efermi": r"E-fermi\s*:\s*([-\d.]+)",
    "total_magnetization": r"number of electron\s+[\d.]+\s+magnetization\s+([-\d.]+)",
}
OUTCAR_STATS = {
    "Total CPU time used (sec)": r"Total CPU time used \(sec\):\s*([\d.]+)",
    "Elapsed time (sec)": r"Elapsed time \(sec\):\s*([\d.]+)",
    "Maximum memory used (kb)": r"Maximum memory used \(kb\):\s*(\d+)",
}


def parse_outcar(files: DataFrame) -> DataFrame:
    """First matches of the output file; neither an energy nor a Fermi level is an error."""
    found = {k: S.as_number(S.first_match(F.col("text"), p)) for k, p in OUTCAR_PATTERNS.items()}
    stats = {k: S.first_match(F.col("text"), p) for k, p in OUTCAR_STATS.items()}
    rows = V.computed(files, **found, stats=F.when(F.coalesce(*stats.values()).isNotNull(), V.json_object({k: V.raw_json(v) for k, v in stats.items()})))
    fields = {k: V.real_field(F.col(k)) for k in OUTCAR_PATTERNS} | {"is_stopped": V.flag_field(F.lit(False)), "run_stats": V.json_field(F.col("stats")), "magnetization": V.json_field(F.lit("[]")), "charge": V.json_field(F.lit("[]"))}
    return V.long_facts(rows, fields, F.when(F.col("final_energy").isNull() & F.col("efermi").isNull(), "no energy and no Fermi level"))
