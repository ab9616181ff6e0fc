"""Quantum-chemistry files: inputs and outputs as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import values as V
from .dft import lines_of

_ENTRY = "struct<block:string,key:string,raw:string>"
_STATE = f"struct<block:string,entries:array<{_ENTRY}>>"


def block_entries(lines: Column) -> Column:
    """Array of struct<block,key,raw> of all ``%name … end`` blocks.

    Lines are read one by one, so a directive that ends on its own line never
    takes the next block with it.
    """
    start = F.struct(F.lit(None).cast("string").alias("block"), F.array().cast(f"array<{_ENTRY}>").alias("entries")).cast(_STATE)
    put = lambda block, entries: F.struct(block.alias("block"), entries.alias("entries")).cast(_STATE)
    none = F.lit(None).cast("string")

    def pairs(block: Column, text: Column) -> Column:
        """The key and value of a line, the key in lower case."""
        p = r"^\s*(\w+)\s+(\S.*?)\s*$"
        entry = F.struct(block.alias("block"), F.lower(F.regexp_extract(text, p, 1)).alias("key"), F.regexp_extract(text, p, 2).alias("raw"))
        return F.when(text.rlike(p), F.array(entry.cast(_ENTRY))).otherwise(F.array().cast(f"array<{_ENTRY}>"))

    def move(state: Column, line: Column) -> Column:
        opened = r"(?i)^%(\w+)\s*(.*)$"
        name, rest = F.lower(F.regexp_extract(line, opened, 1)), F.regexp_extract(line, opened, 2)
        closed = r"(?i)^(.*?)\s*\bend\s*$"
        inside = F.regexp_extract(rest, closed, 1)
        here = state["block"]
        return (
            F.when(line.rlike(opened) & (name == "maxcore"), put(none, state["entries"]))
            .when(line.rlike(opened) & rest.rlike(closed), put(none, F.concat(state["entries"], pairs(name, inside))))
            .when(line.rlike(opened), put(name, F.concat(state["entries"], pairs(name, rest))))
            .when(here.isNull(), state)
            .when(line.rlike(r"(?i)^\s*end\b"), put(none, state["entries"]))
            .otherwise(put(here, F.concat(state["entries"], pairs(here, line))))
        )

    return F.aggregate(lines, start, move)["entries"]


def parse_input(files: DataFrame) -> DataFrame:
    """Keywords, resources, blocks and coordinates of the first job of an input."""
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)^(.*?)(?:(?m:^)\s*\$new_job.*)?$", 1)
    clean = F.regexp_replace(F.regexp_replace(first, r"\r\n", "\n"), r"(?m)[ \t]*#.*$", "")
    rows = V.computed(files, t=clean)
    rows = V.computed(rows, e=block_entries(lines_of(F.col("t"))))
    words = F.flatten(F.transform(F.regexp_extract_all("t", F.lit(r"(?m)^!(.+)$"), F.lit(1)), lambda x: S.words(F.upper(x))))
    coords = r"(?msi)^\*\s+(xyz|int|intxyz|gzmt)\s+(-?\d+)\s+(\d+)\s*\n(.*?)^\*\s*$"
    file_at = r"(?mi)^\*\s+xyzfile\s+(-?\d+)\s+(\d+)\s+(\S+)"
    has, by_file = F.col("t").rlike(coords), F.col("t").rlike(file_at)
    pick = lambda i, j: F.when(has, F.regexp_extract("t", coords, i)).when(by_file, F.regexp_extract("t", file_at, j))
    atoms = F.filter(F.transform(F.split(F.regexp_extract("t", coords, 4), "\n"), lambda x: F.array_join(S.words(x), " ")), lambda x: x != "")
    in_block = lambda b, k: F.try_element_at(F.filter("e", lambda x: (x["block"] == b) & (x["key"] == k)), F.lit(-1))["raw"]
    names = F.array_sort(F.array_distinct(F.transform("e", lambda x: F.struct(x["block"], x["key"]))))
    more = F.transform(names, lambda n: F.struct(F.concat_ws(".", F.lit("block"), n["block"], n["key"]).alias("path"), F.lit("word").alias("mode"), F.element_at(F.filter("e", lambda x: (x["block"] == n["block"]) & (x["key"] == n["key"])), -1)["raw"].alias("text")))
    fields = {
        "keywords": V.json_field(F.to_json(F.array_sort(F.array_distinct(words)))),
        "charge": V.int_field(pick(2, 1)),
        "multiplicity": V.int_field(pick(3, 2)),
        "coord_format": V.string_field(F.when(has, F.lower(F.regexp_extract("t", coords, 1))).when(by_file, "xyzfile")),
        "maxcore": V.int_field(S.last_match(F.col("t"), r"(?mi)^%maxcore\s+(\d+)")),
        "nprocs": V.int_field(F.regexp_extract(in_block("pal", "nprocs"), r"^(\d+)", 1)),
        "coordinates": V.json_field(F.when(has, F.to_json(atoms))),
        "xyzfile": V.string_field(F.when(~has & by_file, F.regexp_extract("t", file_at, 3))),
    }
    return V.long_facts(rows, fields, more=more)


#: Patterns of the output file.
_ENERGY_EV = r"Total Energy\s+:\s+[-\d.]+\s+Eh\s+([-\d.]+)\s+eV"
_DIPOLE = r"Total Dipole Moment\s*:\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)"
_DAYS = r"(?i)TOTAL RUN TIME:\s*(\d+\s+days\s+\d+\s+hours\s+\d+\s+minutes\s+\d+\s+seconds)"


def parse_output(files: DataFrame) -> DataFrame:
    """Results of an output; neither an energy, nor an end, nor a version is an error."""
    t = F.coalesce("text", F.lit(""))
    status = F.when(t.contains("ORCA TERMINATED NORMALLY"), "normal").when(t.rlike(r"(?i)ERROR\s*TERMINATION"), "error")
    cycles = S.first_match(t, r"SCF CONVERGED AFTER\s+(\d+)\s+CYCLES")
    version = F.coalesce(S.first_match(t, r"(?i)Program Version\s+([\d.]+(?:-[\w]+)?)"), S.first_match(t, r"[Tt]his ORCA version\s+([\d.]+)"))
    final = S.as_number(S.last_match(t, r"FINAL SINGLE POINT ENERGY\s+([-\d.]+)"))
    columns = {
        # without the final line, the last total energy in electronvolts
        "energy": F.coalesce(final, F.round(S.hartree(S.as_number(S.last_match(t, _ENERGY_EV))), 10)),
        "dipole": S.vector_norm(F.array(*(S.as_number(S.last_match(t, _DIPOLE, i)) for i in (1, 2, 3)))),
        "status": status,
        "optimized": F.when(t.contains("THE OPTIMIZATION HAS CONVERGED"), F.lit(True)).when(t.contains("THE OPTIMIZATION HAS NOT CONVERGED"), F.lit(False)),
        "charge": S.first_match(t, r"Total Charge\s+Charge\s+\.+\s+([+-]?\d+)"),
        "multiplicity": S.first_match(t, r"Multiplicity\s+Mult\s+\.*\s+(\d+)"),
        "cycles": cycles,
        "converged": F.when(cycles.isNotNull(), F.lit(True)).when(t.rlike(r"(?i)SCF NOT CONVERGED"), F.lit(False)),
        "version": version,
        "wall": S.first_match(t, _DAYS),
    }
    rows = V.computed(files, **columns)
    fields = {
        "final_energy": V.real_field(F.col("energy")),
        "termination_status": V.string_field(F.col("status")),
        "optimization_converged": V.flag_field(F.col("optimized")),
        "charge": V.int_field(F.col("charge")),
        "multiplicity": V.int_field(F.col("multiplicity")),
        "scf_cycles": V.int_field(F.col("cycles")),
        "scf_converged": V.flag_field(F.col("converged")),
        "orca_version": V.string_field(F.col("version")),
        "dipole_moment": V.real_field(F.col("dipole")),
        "wall_time": V.string_field(F.col("wall")),
    }
    return V.long_facts(rows, fields, F.when(F.coalesce(F.col("energy").cast("string"), "status", "version").isNull(), "no energy, end or version"))
