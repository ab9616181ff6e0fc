"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: electronvolts to Hartree.
EV_TO_HARTREE = 1.0 / 27.211386245988
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def is_hash(text: Column) -> Column:
    """64 hex digits; null and malformed values are false."""
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def hartree(energy_ev: Column) -> Column:
    return energy_ev * EV_TO_HARTREE


def vector_norm(components: Column, digits: int = 6) -> Column:
    """Length of a vector, rounded; null for null, empty vectors and vectors with a null in them."""
    whole = (F.size(components) > 0) & F.forall(components, lambda x: x.isNotNull())
    return F.when(whole, F.round(F.sqrt(F.aggregate(components, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), digits))


def looked_up(table: Column, key: Column, default: Column) -> Column:
    """A map's value, or the default for keys that it does not have."""
    return F.coalesce(F.try_element_at(table, key), default)


def short_hash(text: Column, digits: int = 7) -> Column:
    return F.substring(text, 1, digits)


def shard(blob_hash: Column) -> Column:
    """The first two digits, which name a blob's shard."""
    return F.substring(blob_hash, 1, 2)


def shard_path(blob_hash: Column, suffix: str = "") -> Column:
    """Two digits as a folder, the rest as the file."""
    return F.concat(shard(blob_hash), F.lit("/"), F.substring(blob_hash, 3, 64), F.lit(suffix))


def human_size(size: Column) -> Column:
    """Ties are rounded to even, as C and Python print them."""
    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("bigint")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", F.bround(size / 1024.0, 1)))
        .otherwise(F.format_string("%.2f MB", F.bround(size / 1048576.0, 2)))
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def iso_time(text: Column) -> Column:
    """ISO-8601 text (``Z`` allowed) as a timestamp; null if malformed."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def show_time(text: Column) -> Column:
    """``YYYY-mm-dd HH:MM:SS`` of an ISO-8601 text in the session's time zone."""
    return F.date_format(iso_time(text), "yyyy-MM-dd HH:mm:ss")


def utc_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(text.rlike(pattern), found)


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def as_number(text: Column) -> Column:
    """A double if the text is a plain number, else null (``1D`` is none)."""
    return F.when(F.trim(text).rlike(NUMERIC), F.trim(text).try_cast("double"))


def is_integer(text: Column) -> Column:
    return F.trim(text).rlike(INTEGER)


def words(text: Column) -> Column:
    """White-space separated words; no words for blank text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def expanded(text: Column) -> Column:
    """``2*0.6 1.0`` as [0.6, 0.6, 1.0]; null if a word is not numeric."""

    def one(w: Column) -> Column:
        times = F.regexp_extract(w, r"^(\d+)\*", 1)
        value = as_number(F.regexp_replace(w, r"^\d+\*", ""))
        return F.when(times != "", F.array_repeat(value, F.coalesce(times.try_cast("int"), F.lit(1)))).otherwise(F.array(value))

    out = F.flatten(F.transform(words(text), one))
    return F.when(F.forall(out, lambda x: x.isNotNull()), out)


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression in which ``*`` crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: ``dir/`` is a prefix from the root, others match the path or its last name."""
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            hit = hit | path.startswith(p)
        else:
            regex = glob_regex(p)
            hit = hit | path.rlike(regex) | basename(path).rlike(regex)
    return hit


def ignore_patterns(text: str | None) -> list[str]:
    """Patterns of an ignore file: blank lines and comments dropped."""
    lines = (x.strip() for x in (text or "").splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def _common_types(name: Column) -> tuple[Column, Column, Column]:
    log = name.startswith("LOG.") | name.endswith(".LOG")
    data = (name == "DATA") | name.startswith("DATA.") | name.endswith(".LMP") | name.endswith(".DATA")
    script = name.startswith("IN.") | name.endswith(".LAMMPS") | (name == "LAMMPS.IN")
    return log, data, script


def type_at_diff(path: Column) -> Column:
    """The parser of a file by its name; null for none. Quantum-chemistry suffixes come before the rules for logs."""
    name = F.upper(basename(path))
    log, data, script = _common_types(name)
    return (
        F.when(name == "INCAR", "INCAR").when(name == "KPOINTS", "KPOINTS").when(name.isin("POSCAR", "CONTCAR"), "POSCAR")
        .when(name.startswith("POTCAR"), "POTCAR").when(name == "OUTCAR", "OUTCAR")
        .when(name.endswith(".INP"), "ORCA_INPUT").when(name.endswith(".OUT") & (name != "OUTCAR.OUT"), "ORCA_OUTPUT")
        .when(log, "LAMMPS_LOG").when(data, "LAMMPS_DATA").when(script, "LAMMPS_INPUT")
    )


def type_at_staging(path: Column) -> Column:
    """The type recorded when a file is staged; differs from ``type_at_diff`` on purpose in order and in its rest."""
    plain = basename(path)
    name = F.upper(plain)
    log, data, script = _common_types(name)
    return (
        F.when(name == "INCAR", "INCAR").when(name == "KPOINTS", "KPOINTS").when(name.isin("POSCAR", "CONTCAR"), "POSCAR")
        .when(name == "POTCAR", "POTCAR").when(name == "OUTCAR", "OUTCAR").when(name == "VASPRUN.XML", "VASPRUN").when(name == "OSZICAR", "OSZICAR")
        .when(log, "LAMMPS_LOG").when(data, "LAMMPS_DATA").when(script, "LAMMPS_INPUT")
        .when(name.endswith(".INP"), "ORCA_INPUT").when(name.endswith(".OUT") & (name != "OUTCAR.OUT"), "ORCA_OUTPUT")
        .when(plain.endswith(".json"), "JSON").when(plain.endswith(".txt"), "TEXT").otherwise("UNKNOWN")
    )


#: Types with a parser.
PARSED_TYPES = ("INCAR", "KPOINTS", "OUTCAR", "LAMMPS_INPUT", "LAMMPS_DATA", "LAMMPS_LOG", "ORCA_INPUT", "ORCA_OUTPUT")


def can_parse(file_type: Column) -> Column:
    return F.coalesce(file_type.isin(*PARSED_TYPES), F.lit(False))
