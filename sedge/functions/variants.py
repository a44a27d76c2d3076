"""JSON as variants, held to its types: a number in quotes is no number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_variant(text: str | Column) -> Column:
    """A text that is one JSON value, and nothing after it, as a variant; else null (also where an object repeats a key).

    ``try_parse_json`` stops behind the first value. Here the text stands in a list before its own hash, so the hash is the
    second value only if the text is exactly one.
    """
    c = F.col(text) if isinstance(text, str) else text
    return _first(_both(c), c)


def _both(c: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(","), F.xxhash64(c).cast("string"), F.lit("]")))


def _first(both: Column, c: Column) -> Column:
    return F.when(F.try_variant_get(both, "$[1]", "long") == F.xxhash64(c), F.try_variant_get(both, "$[0]", "variant"))


def with_variant(rows: DataFrame, text: str, to: str) -> DataFrame:
    """``rows`` with :func:`json_variant` of ``text``, which is parsed once: as one expression it would be twice."""
    own = rows.withColumn("_both", _both(F.col(text)))
    return own.withColumn(to, _first(F.col("_both"), F.col(text))).drop("_both")


def with_listed(rows: DataFrame, text: str, to: str) -> DataFrame:
    """As :func:`with_variant`, but the value stays in its list, so paths begin with ``$[0]``: taking it out writes it anew."""
    own = rows.withColumn("_both", _both(F.col(text)))
    return own.withColumn(to, F.when(F.try_variant_get("_both", "$[1]", "long") == F.xxhash64(text), F.col("_both"))).drop("_both")


def kind_at(path: str, v: str | Column = "_v") -> Column:
    """The kind of JSON value at a path: STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID and so on; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def string_at(path: str, v: str | Column = "_v") -> Column:
    return F.when(kind_at(path, v) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(path: str, v: str | Column = "_v") -> Column:
    """A whole number that is not negative and fits a long, else null."""
    n = F.try_variant_get(v, path, "long")
    return F.when((kind_at(path, v) == "BIGINT") & (n >= 0), n)


def keys_at(path: str, v: str | Column = "_v") -> Column:
    """The keys of an object, else null. Its values are neither looked into nor written anew: none of them has a field."""
    return F.map_keys(F.try_variant_get(v, path, "map<string,struct<>>"))


def object_at(path: str, v: str | Column = "_v") -> Column:
    return F.coalesce(F.startswith(kind_at(path, v), F.lit("OBJECT")), F.lit(False))
