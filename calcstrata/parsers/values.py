"""Fact values: kind, number and JSON text, and how wide rows become long facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

VALUE = "struct<kind:string,num:double,value:string>"
FACTS = ("blob_hash", "path", "kind", "num", "value")
ERROR = "$error"


def _value(kind: Column | str, num: Column, text: Column, present: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(present, F.struct(kind.alias("kind"), num.cast("double").alias("num"), text.alias("value")))


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def integer(text: Column) -> Column:
    n = text.try_cast("bigint")
    return _value("int", n, n.cast("string"), n.isNotNull())


def real(number: Column) -> Column:
    return _value("double", number, number.cast("string"), number.isNotNull())


def truth(flag: Column) -> Column:
    return _value("bool", flag.cast("int"), F.when(flag, "true").otherwise("false"), flag.isNotNull())


def string(text: Column) -> Column:
    return _value("string", F.lit(None), quoted(text), text.isNotNull())


def json(text: Column) -> Column:
    return _value("json", F.lit(None), text, text.isNotNull())


def number_or_text(text: Column) -> Column:
    """An integer, else a real number, else the text itself."""
    return F.when(S.is_integer(text), integer(F.trim(text))).when(S.as_number(text).isNotNull(), real(S.as_number(text))).otherwise(string(text))


def raw_json(text: Column) -> Column:
    """JSON of a word: a number as a double, else a string; null stays null."""
    return F.coalesce(S.as_number(text).cast("string"), F.when(text.isNotNull(), quoted(text)))


def json_object(pairs: dict[str, Column]) -> Column:
    """A JSON object of JSON values; absent ones are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose expressions are evaluated once.

    The generator keeps the optimizer from copying a long expression into
    each place that uses the column.
    """
    once = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_once")
    return df.select("*", once).select(*df.columns, *(F.col(f"_once.{k}").alias(k) for k in columns))


#: A field of ``long_facts``: how its text is typed (``int``, ``double``, ``bool``, ``string``, ``json``, or ``word``: an integer, else a real number, else text), and the text; null if absent.
Field = tuple[str, Column]
ITEM = "struct<path:string,mode:string,text:string>"


def int_field(text: Column) -> Field:
    return "int", text


def real_field(number: Column) -> Field:
    return "double", number.cast("string")


def flag_field(flag: Column) -> Field:
    return "bool", flag.cast("string")


def string_field(text: Column) -> Field:
    return "string", text


def json_field(text: Column) -> Field:
    return "json", text


def word_field(text: Column) -> Field:
    return "word", text


def long_facts(rows: DataFrame, fields: dict[str, Field], error: Column | None = None, more: Column | None = None) -> DataFrame:
    """One row a fact (blob_hash, path, kind, num, value).

    ``error``: a message for blobs that cannot be parsed; they have one fact
    with the path ``$error``. ``more``: an array of struct<path,mode,text> for
    facts whose names come from the text.

    Texts become rows before they are typed, so that the plan has the typing
    once and not in each field: expressions stay small for the driver and for
    the compiler of generated code.
    """
    texts = {f"_v{i}": text for i, (_, text) in enumerate(fields.values())}
    if more is not None:
        texts["_more"] = more
    if error is not None:
        texts["_error"] = error
    rows = rows.select("blob_hash", *(c.alias(k) for k, c in texts.items()))
    entry = lambda path, mode, c: F.struct(F.lit(path).alias("path"), F.lit(mode).alias("mode"), F.col(c).alias("text"))
    items = F.array(*(entry(p, mode, f"_v{i}") for i, (p, (mode, _)) in enumerate(fields.items())))
    if more is not None:
        items = F.concat(items, F.coalesce("_more", F.array().cast(f"array<{ITEM}>")))
    if error is not None:
        items = F.when(F.col("_error").isNotNull(), F.array(entry(ERROR, "string", "_error"))).otherwise(items)
    long = rows.select("blob_hash", F.explode(items).alias("f")).select("blob_hash", "f.*").where("text is not null")
    text = F.col("text")
    word = F.when(S.is_integer(text), "int").when(S.as_number(text).isNotNull(), "double").otherwise("string")
    typed = long.select("blob_hash", "path", F.when(F.col("mode") == "word", word).otherwise(F.col("mode")).alias("kind"), "text")
    kind, n, x = F.col("kind"), F.trim(text).try_cast("bigint"), F.trim(text).try_cast("double")
    num = F.when(kind == "int", n.cast("double")).when(kind == "double", x).when(kind == "bool", F.when(text == "true", 1.0).otherwise(0.0))
    value = F.when(kind == "int", n.cast("string")).when(kind == "double", x.cast("string")).when(kind == "string", quoted(text)).otherwise(text)
    return typed.select("blob_hash", "path", "kind", num.alias("num"), value.alias("value")).where("value is not null")
