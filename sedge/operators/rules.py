"""Decision tables and containment checks."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.probes import bitmap, item_keys, text_keys
from sedge.functions.spread import cut
from sedge.functions.udfs import nfkc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def allowed_in_order(wanted: Column, allowed: Column) -> Column:
    """The members of ``wanted`` that ``allowed`` has too, in wanted's order."""
    return F.filter(wanted, lambda x: F.array_contains(allowed, x))


def stamped(tags: Column, more: Column) -> Column:
    """Tags with others appended, each once, in order of first appearance."""
    return F.array_distinct(F.concat(tags, more))


def normal_tag(c: Column) -> Column:
    """NFKC, ASCII lower case, other characters than ASCII letters and digits to single hyphens, none at the ends."""
    return plain_tag(nfkc(c))


def plain_tag(c: Column) -> Column:
    """:func:`normal_tag` of what is NFKC already."""
    low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def stem_hits(rows: DataFrame, stems: Sequence[tuple[str, str]], text: str = "text") -> DataFrame:
    """``rows`` with ``hits``, the sorted canonical tags whose stem the text holds, both sides normalised; ``stems`` are the
    caller's short list of (stem, canonical tag). A stem that normalises to nothing hits nothing."""
    return rows.withColumn("_n", normal_tag(F.col(text))).withColumn("hits", stems_in(F.col("_n"), stems)).drop("_n")


def stems_in(tag: Column, stems: Sequence[tuple[str, str]]) -> Column:
    """The sorted canonical tags whose stem a text of :func:`normal_tag` holds, which is read once for each."""
    named = [(w, name) for stem, name in stems if (w := re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKC", stem).translate(LOWER)).strip("-"))]
    return those_of([(tag.contains(w), name) for w, name in named])


def those_of(found: Sequence[tuple[Column, str]]) -> Column:
    """The sorted names with some condition that holds. Sorted here, as lambdas over arrays are not compiled."""
    by = {tag: functools.reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c, t in found if t == tag]) for tag in sorted({t for _, t in found})}
    none = F.lit(None).cast("string")
    return F.array_except(F.array(none, *[F.when(c, F.lit(tag)) for tag, c in by.items()]), F.array(none))


def admit(rows: DataFrame, label: str, ranks: Sequence[str], required: Column) -> DataFrame:
    """``custody`` (the label, if known), ``admitted`` and ``reason``: the first check that fails, by rank order."""
    order = F.array(*[F.lit(r) for r in ranks])
    own = T.custody_label(F.col(label))
    at, need = F.array_position(order, own), F.array_position(order, required)
    known = F.coalesce(at > 0, F.lit(False))
    reason = F.when(~known, "unknown-label").when(at < need, "below-required")
    return rows.withColumn("custody", F.when(known, own)).withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def root_class(tags: Column, classes: Sequence[tuple[str, str]], default: str) -> Column:
    """An ordered decision table: the class of the first tag in it that ``tags`` has."""
    return F.coalesce(*[F.when(F.array_contains(tags, tag), F.lit(name)) for tag, name in classes], F.lit(default))


def inherits(children: DataFrame, parents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Children with ``missing_parent`` and the fields in which they differ from their parent."""
    p = parents.select(F.col("id").alias("parent_id"), F.lit(True).alias("_there"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    own = children.join(p, "parent_id", "left").withColumn("missing_parent", F.col("_there").isNull())
    own = own.withColumn("differs", F.array_compact(F.array(*[F.when(F.col("_there") & ~F.col(f).eqNullSafe(F.col(f"_p_{f}")), F.lit(f)) for f in fields])))
    return own.drop("_there", *[f"_p_{f}" for f in fields])


def pack(rows: DataFrame, key: str, item: str, order: str, limit: int) -> DataFrame:
    """(key, reply, items): items in order, packed into replies of at most ``limit`` characters with one comma between.

    Where an item goes depends on all before it, so a key's items are one group; a key is one reply's worth of ids. An
    item longer than the limit makes a reply of its own.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[list[str]] = []
        size = 0
        for x in group.sort_values("_o")["_i"]:
            if out and size + 1 + len(x) <= limit:
                out[-1].append(x)
                size += 1 + len(x)
            else:
                out.append([x])
                size = len(x)
        return pd.DataFrame({"key": [group["_k"].iloc[0]] * len(out), "reply": range(1, len(out) + 1), "items": out})

    own = rows.select(F.col(key).cast("string").alias("_k"), F.col(item).cast("string").alias("_i"), F.col(order).alias("_o"))
    return own.groupBy("_k").applyInPandas(run, "key string, reply int, items array<string>")


def contained(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """(doc_id, item_id) where a text holds an item whole, as a substring of it.

    Both sides meet on a hash, so this is an equi join: of the inner words of the item's first ``words`` (its first and
    last may be parts of longer words), and for items of fewer than three words of their first bytes, six at most. Keys that no
    item may have are left out where texts are read (:mod:`sedge.functions.probes`), and only keys travel; a text meets the
    items that its keys propose once. Empty items are in every text that is not null.
    """
    own = docs.where("text is not null").select("doc_id", "text")
    want = items.where("text <> ''").select("item_id", "text")
    keys = cut(item_keys(want, words))
    kinds = [r._kind for r in keys.select("_kind").distinct().collect()]  # at most ``words`` + 2 numbers
    proposed = text_keys(own, kinds, bitmap(keys)).join(keys.select("item_id", "_k"), "_k").select("doc_id", "item_id").distinct()
    met = proposed.join(want.withColumnRenamed("text", "_t"), "item_id").join(own, "doc_id")
    found = met.where(F.col("text").contains(F.col("_t"))).select("doc_id", "item_id").distinct()
    empty = items.where("text = ''").select(F.lit(1).alias("_all"), "item_id")
    if empty.isEmpty():
        return found
    return found.unionByName(own.select(F.lit(1).alias("_all"), "doc_id").join(empty, "_all").select("doc_id", "item_id").distinct())


def bound_claims(claims: DataFrame, cards: DataFrame) -> DataFrame:
    """Expected claims (case_id, claim, source, line_start, line_end) with ``bound``: a card of the case holds the claim,
    and every card that does has its source and lines."""
    c = cards.select("case_id", F.col("claim").alias("_c"), F.col("source").alias("_s"), F.col("line_start").alias("_a"), F.col("line_end").alias("_z"))
    same = (F.col("_s") == F.col("source")) & (F.col("_a") == F.col("line_start")) & (F.col("_z") == F.col("line_end"))
    hit = claims.join(c, "case_id", "left").withColumn("_has", F.coalesce(F.col("_c").contains(F.col("claim")), F.lit(False)))
    return hit.groupBy("case_id", "claim", "source", "line_start", "line_end").agg(F.coalesce(F.bool_and(F.when(F.col("_has"), same)), F.lit(False)).alias("bound"))


def dimension_rollup(results: DataFrame) -> DataFrame:
    """Per dimension (case_id, dimension, passed or null for not applicable): applicable, passed, and whether all did."""
    return results.groupBy("dimension").agg(F.count("passed").alias("applicable"), F.count_if("passed").alias("passed_cases"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok"))


def valid_id(c: Column) -> Column:
    """A case's id: lower-case ASCII letters, digits and hyphens, 64 at most, no hyphen first."""
    return F.coalesce(c.rlike(r"\A[a-z0-9][a-z0-9-]{0,63}\z"), F.lit(False))


def valid_tier(c: Column) -> Column:
    """A trust tier, but for white space at its ends: a visible ASCII label of 128 characters at most."""
    return F.coalesce(T.strip(c).rlike(r"\A[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}\z"), F.lit(False))


def valid_label(c: Column) -> Column:
    """A label of a run, if any: 1 to 4,096 visible ASCII characters, but for white space at its ends."""
    own = T.strip(c)
    return c.isNull() | (own.rlike(r"\A[\x21-\x7E]+\z") & (F.length(own) <= 4096))


def valid_source(c: Column) -> Column:
    """A path without backticks, control and format characters, and line separators."""
    return F.coalesce(~c.rlike(r"[`\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), F.lit(False))


def expected_and_emitted(expected: DataFrame, emitted: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, place, expected, emitted, same): inputs that a case names against those that its run lists, place by place;
    both (by, order, name)."""
    number = lambda df, to: df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("place"), F.col("name").alias(to))
    both = number(expected, "expected").join(number(emitted, "emitted"), [*by, "place"], "full")
    return both.withColumn("same", F.coalesce(F.col("expected") == F.col("emitted"), F.lit(False)))


def section_refs(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """(run, section, ord, ref, resolved): references of a summary's sections with the claim lines that they stand for;
    ``lines``: run, section, ord, line; ``claims``: run, ref, line. A reference without a claim is not resolved."""
    ref = F.regexp_extract("line", r"\A- (\S+)(?: \[[^\]]*\])*\z", 1)
    own = lines.select("run", "section", "ord", ref.alias("ref")).where("ref <> ''")
    return own.join(claims.select("run", "ref", F.col("line").alias("resolved")), ["run", "ref"], "left").select("run", "section", "ord", "ref", "resolved")
