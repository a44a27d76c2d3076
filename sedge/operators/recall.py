"""Recall of marked lines: which of them a hand-off still holds, each kept claim being spent once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators.cards import line_rows

KINDS = ("critical_constraints", "open_questions")


def _kind(c):
    return {KINDS[0]: T.is_critical(c), KINDS[1]: T.is_question(c)}


def recognized(docs: DataFrame, key: str = "doc_id", text: str = "redacted") -> DataFrame:
    """(key, line_number, kind, line_text, full_claim): a row for each marked line and kind."""
    bare = T.strip("line")
    rows = line_rows(docs, key, text).withColumn("line_text", bare).where("line_text <> ''")
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in _kind(F.col("line_text")).items()]))
    return rows.select(key, "line_number", "line_text", T.clean_claim(F.col("line"), F.greatest(F.length("line") + 1, F.lit(221))).alias("full_claim"), F.explode(kinds).alias("kind"))


def claim_slots(cards: DataFrame, key: str = "doc_id", all_cards: bool = False, code_kept: bool = True) -> DataFrame:
    """(key, kind, claim): a slot for each card of a kind whose claim stays as it is when defanged.

    A summary's slots come from cards marked by claim or evidence; ``all_cards`` gives every card a slot of each kind.
    """
    whole = F.concat_ws("\n", "claim", "evidence")
    same = (T.defang_claim(F.col("claim")) if code_kept else T.defang(F.col("claim"))) == F.col("claim")
    kinds = F.array(*[F.lit(k) for k in KINDS]) if all_cards else F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in _kind(whole).items()]))
    return cards.where(same).select(key, F.explode(kinds).alias("kind"), F.col("claim").alias("full_claim"))


def spent(lines: DataFrame, slots: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, recognized, retained): marked lines met by slots of the same claim, one for one in line order."""
    by = [key, "kind", "full_claim"]
    nth = Window.partitionBy(*by)
    left = lines.withColumn("_n", F.row_number().over(nth.orderBy("line_number")))
    right = slots.groupBy(*by).agg(F.count("*").alias("_slots"))
    return left.join(right, by, "left").groupBy(key, "kind").agg(F.count("*").alias("recognized"), F.sum((F.col("_n") <= F.coalesce("_slots", F.lit(0))).cast("long")).alias("retained"))


def _assign(group: pd.DataFrame) -> pd.DataFrame:
    """In card order each card takes the free line that its claim equals, else the lowest free one in its window."""
    taken: set[int] = set()
    for _, own in group.sort_values(["card_rank", "other", "line_number"]).groupby("card_rank", sort=True):
        free = [n for n in own["line_number"] if n not in taken]
        if free:
            taken.add(int(free[0]))
    first = group.iloc[0]
    return pd.DataFrame({"doc_id": [first["doc_id"]] * len(taken), "kind": [first["kind"]] * len(taken), "line_number": sorted(taken)})


def authoritative(lines: DataFrame, cards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, kind, line_number): the lines that cards stand for. A card stands for one line of a kind at most, in its
    window and evidence; a group is a document's cards of a kind, at most max_cards times three rows."""
    c = cards.select(F.col(key).alias("doc_id"), "card_rank", "claim", "line_start", "line_end", F.transform(F.split("evidence", "\n"), T.strip).alias("_ev"))
    near = c.withColumn("line_number", F.explode(F.sequence("line_start", "line_end")))
    hit = near.join(lines.withColumnRenamed(key, "doc_id"), ["doc_id", "line_number"]).where(F.array_contains("_ev", F.col("line_text")))
    match = hit.withColumn("other", (T.card_claim(F.col("line_text")) != F.col("claim")).cast("int")).select("doc_id", "kind", "card_rank", "other", "line_number")
    return match.groupBy("doc_id", "kind").applyInPandas(_assign, "doc_id bigint, kind string, line_number int")


def status(counts: DataFrame) -> DataFrame:
    """``counts`` (recognized, retained) with lost and status: not measured without marked lines, else pass or loss."""
    return counts.withColumn("lost", F.col("recognized") - F.col("retained")).withColumn("status", F.when(F.col("recognized") == 0, "not-applicable").when(F.col("lost") == 0, "pass").otherwise("recall-loss"))

