"""Validation: rules as data, applied in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..parsers.values import computed


@dataclass(frozen=True)
class Rule:
    """broken: a condition under which the message is given; null counts as not broken."""

    name: str
    level: str
    broken: Column
    message: str | Column


def messages(rules: list[Rule], level: str) -> Column:
    """A message or null for each rule of the level, in order."""
    own = [F.when(r.broken, F.lit(r.message) if isinstance(r.message, str) else r.message) for r in rules if r.level == level]
    return F.array(*own).cast("array<string>")


def told(messages: Column) -> Column:
    return F.filter(messages, lambda m: m.isNotNull())


def with_messages(df: DataFrame, errors: Column, warnings: Column) -> DataFrame:
    """Adds errors, warnings and passed (no error), from a message or null for each rule.

    The rules are evaluated before their messages are filtered: inside of the
    filter they would not be in generated code.
    """
    out = computed(df, _errors=errors, _warnings=warnings)
    out = out.select(*df.columns, told(F.col("_errors")).alias("errors"), told(F.col("_warnings")).alias("warnings"))
    return out.withColumn("passed", F.size("errors") == 0)


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return with_messages(df, messages(rules, "error"), messages(rules, "warning"))
