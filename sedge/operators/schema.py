"""Closed schemas of JSON documents, as tables: a row for each path with its kinds, bounds and pattern.

A document is taken apart level by level by a table function, along paths that the schema knows and whose kind fits. At
each object the keys that are there and those that should be are set against each other both ways. Documents of any number
are judged by joins with the schema alone, which is a small fixed table and is broadcast.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.variants import json_variant


@dataclass(frozen=True)
class Field:
    """``path``: ``$``, ``.key`` for a key, ``[]`` for each entry of a list. ``least`` and ``most`` bound a whole number, or
    the number of entries of a list; ``pattern`` is what all of a text, a number or a boolean must match."""

    path: str
    kinds: str  # of object, array, string, integer, number, boolean, null; joined by |
    least: int | None = None
    most: int | None = None
    pattern: str | None = None
    required: bool = True


ROWS = "path string, kinds string, least bigint, most bigint, pattern string, required boolean"


def kind_of(v: Column) -> Column:
    """The kind of a variant by its JSON name; whole numbers beyond a long are still integers, to 38 digits."""
    s = F.schema_of_variant(v)
    named = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(s.rlike(r"\ADECIMAL\([0-9]+,0\)\z"), "integer")
    for prefix, name in named.items():
        out = out.when(s.startswith(prefix), name)
    return out.otherwise("number")


def _levels(fields: list[Field]) -> int:
    return max(f.path.count(".") + f.path.count("[]") for f in fields)


def sound(v: Column, fields: list[Field]) -> Column:
    """True only where a variant breaks no rule of a flat schema (an object of scalars and lists of scalars), seen from its
    whole kind at once and without taking it apart. What is not true here may be sound all the same: :func:`errors` says.
    The kinds are written out for each choice of optional keys and kinds, so there must be few of these."""
    plain = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
    below = {f.path[:-2]: f for f in fields if f.path.endswith("[]")}
    choices, holds = [], []
    for f in sorted((f for f in fields if f.path != "$" and not f.path.endswith("[]")), key=lambda f: f.path):
        name, part = f.path.removeprefix("$."), F.try_variant_get(v, f.path, "string")
        if f.kinds == "array":
            inner = below.get(f.path)
            kinds = ["ARRAY<VOID>"] + [f"ARRAY<{plain[k]}>" for k in inner.kinds.split("|") if k in plain and inner.pattern is None and inner.least is inner.most is None]
            listed = F.try_variant_get(v, f.path, "array<string>")
            held = ~F.exists(listed, lambda x: x.isNull()) & F.size(listed).between(f.least or 0, (1 << 31) - 1 if f.most is None else f.most)  # a null in a list does not show in its kind
        else:
            kinds = [plain[k] for k in f.kinds.split("|") if k in plain]
            number = F.try_variant_get(v, f.path, "long")
            held = F.lit(True) if f.pattern is None else part.rlike(rf"\A(?:{f.pattern})\z")
            for bound, fits in ((f.least, lambda x: number >= x), (f.most, lambda x: number <= x)):
                held = held if bound is None else held & fits(bound)
        holds.append(held if f.required else F.try_variant_get(v, f.path, "variant").isNull() | held)
        choices.append([f"{name}: {k}" for k in kinds] + ([] if f.required else [None]))
    shapes = ["OBJECT<" + ", ".join(x for x in c if x) + ">" for c in product(*choices)]
    return F.coalesce(reduce(lambda a, b: a & b, holds, F.schema_of_variant(v).isin(*shapes)), F.lit(False))


def errors(docs: DataFrame, fields: list[Field], key: str, json: str = "json") -> DataFrame:
    """(key, errors): for each document the sorted names of what is wrong, none for a sound one.

    ``not-json``; ``missing:``, ``unknown:``, ``kind:``, ``range:`` and ``value:`` with the place. What lies below an unknown
    key or a value of the wrong kind is not looked at. Null documents are no JSON. Keys other than letters, digits and
    underscores are quoted, so they are never taken for a path.
    """
    spark: SparkSession = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([astuple(f) for f in fields], ROWS))
    names = [(f.path.rpartition(".")[0], f.path.rpartition(".")[2], f.required) for f in fields if not f.path.endswith("[]") and f.path != "$"]
    keys = spark.createDataFrame(names, "path string, name string, required boolean").groupBy("path").agg(F.collect_list("name").alias("known"), F.collect_list(F.when(F.col("required"), F.col("name"))).alias("wanted"))
    here = docs.select(key, F.lit("$").alias("at"), F.lit("$").alias("path"), json_variant(json).alias("v"))
    found = [here.where("v is null").select(key, F.lit("not-json").alias("error"))]
    here = here.where("v is not null")
    for _ in range(_levels(fields) + 1):
        own = here.join(table, "path").withColumn("kind", kind_of(F.col("v"))).join(F.broadcast(keys), "path", "left")
        fits = F.array_contains(F.split("kinds", r"\|"), F.col("kind"))
        there = F.json_object_keys(F.to_json("v"))
        none = F.array().cast("array<string>")
        said = lambda what, names: F.transform(names, lambda n: F.concat(F.lit(f"{what}:"), "at", F.lit("."), n))
        of_object = F.when(F.col("kind") == "object", F.concat(said("missing", F.array_except(F.coalesce("wanted", none), there)), said("unknown", F.array_except(there, F.coalesce("known", none))))).otherwise(none)
        amount = F.when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>"))).otherwise(F.try_variant_get("v", "$", "decimal(38,0)")).cast("decimal(38,0)")
        bounded = F.col("kind").isin("integer", "array") & ~(F.coalesce(amount >= F.col("least"), F.lit(True)) & F.coalesce(amount <= F.col("most"), F.lit(True)))
        odd = F.col("kind").isin("string", "integer", "number", "boolean") & F.col("pattern").isNotNull() & ~F.coalesce(F.rlike(F.try_variant_get("v", "$", "string"), F.concat(F.lit(r"\A(?:"), "pattern", F.lit(r")\z"))), F.lit(False))
        one = lambda what: F.array(F.concat(F.lit(f"{what}:"), "at"))
        all_ = F.when(~fits, one("kind")).otherwise(F.concat(of_object, F.when(bounded, one("range")).otherwise(none), F.when(odd, one("value")).otherwise(none)))
        found.append(own.select(key, F.explode(all_).alias("error")))
        into = own.where(fits & F.col("kind").isin("object", "array")).select(key, "at", "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        plain = F.when(F.col("_key").rlike(r"\A[A-Za-z0-9_]+\z"), F.concat(F.lit("."), "_key")).otherwise(F.concat(F.lit('["'), "_key", F.lit('"]')))
        step = lambda index: F.when(F.col("_key").isNull(), index).otherwise(plain)
        here = into.select(key, F.concat("at", step(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))).alias("at"), F.concat("path", step(F.lit("[]"))).alias("path"), F.col("_value").alias("v"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return docs.select(key).distinct().join(out, key, "left").groupBy(key).agg(F.array_sort(F.collect_set("error")).alias("errors"))
