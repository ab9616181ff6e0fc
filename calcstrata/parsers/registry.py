"""Parsers by file type, and facts of many files with each distinct content parsed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import dft, md, qc, rules

FACTS = "blob_hash string, file_type string, path string, kind string, num double, value string"

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "INCAR": dft.parse_incar,
    "KPOINTS": dft.parse_kpoints,
    "OUTCAR": dft.parse_outcar,
    "LAMMPS_INPUT": md.parse_script,
    "LAMMPS_DATA": md.parse_data,
    "LAMMPS_LOG": md.parse_log,
    "ORCA_INPUT": qc.parse_input,
    "ORCA_OUTPUT": qc.parse_output,
}


#: Names of files of further types: a condition on the path, by type.
NAMES: dict[str, Callable[[Column], Column]] = {}


def register(file_type: str, parser: Callable[[DataFrame], DataFrame], names: Callable[[Column], Column] | None = None, order: tuple[str, ...] = (), critical: tuple[str, ...] = (), major: tuple[str, ...] = (), tolerances: dict[str, float] | None = None) -> None:
    """A further type: its parser from (blob_hash, text) to facts, how its files are called, and how its facts are compared.

    ``order`` lists the paths that are compared, in order; without it all
    are, by path. Paths in neither list of significance are minor. Numbers
    closer than a path's tolerance are equal.
    """
    PARSERS[file_type] = parser
    if names is not None:
        NAMES[file_type] = names
    if order:
        rules.ORDER[file_type] = tuple(order)
    rules.CRITICAL[file_type], rules.MAJOR[file_type] = tuple(critical), tuple(major)
    rules.TOLERANCES[file_type] = dict(tolerances or {})


def unregister(file_type: str) -> None:
    for table in (PARSERS, NAMES, rules.ORDER, rules.CRITICAL, rules.MAJOR, rules.TOLERANCES):
        table.pop(file_type, None)


def type_of(path: Column) -> Column:
    """The parser of a file by its name, further types after the built-in ones; null for none."""
    return F.coalesce(S.type_at_diff(path), *(F.when(names(path), kind) for kind, names in NAMES.items()))


def can_parse(path: Column) -> Column:
    return F.coalesce(type_of(path).isin(*PARSERS), F.lit(False))


def facts_of(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Facts (blob_hash, file_type, path, kind, num, value) of files (blob_hash, file_type, text).

    Contents that several files share are parsed once. Each type's parser
    reads its own rows, so a caller that knows which types occur should say
    so: the others are not planned.
    """
    if types is not None and not types:
        return files.sparkSession.createDataFrame([], FACTS)
    out = None
    for kind in types or PARSERS:
        own = files.where(F.col("file_type") == kind).select("blob_hash", "text").dropDuplicates(["blob_hash"])
        found = PARSERS[kind](own).select("blob_hash", F.lit(kind).alias("file_type"), "path", "kind", "num", "value")
        out = found if out is None else out.unionByName(found)
    return out
