"""Whole runs: documents in; cards, a summary and a manifest out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.spread import cut, ordinals
from sedge.functions.udfs import round4
from sedge.operators import cards as C
from sedge.operators import render


@dataclass
class Run:
    documents: DataFrame
    cards: DataFrame
    summary: DataFrame
    manifest: DataFrame
    findings: DataFrame
    places: DataFrame


def condense(documents: DataFrame, run_id: str | None, default_tier: str = "untrusted", overrides: DataFrame | None = None, max_cards: int = 24, max_bytes: int = 2_000_000) -> Run:
    """``documents`` has source and content (bytes), and ``position`` where their order is not that of their sources. Those
    over the cap or not UTF-8 are withheld: they keep their digest in the manifest and give no text. A source may come
    more than once; each row is an input. Where ``run_id`` is None, documents have a column of that name and are of many runs.

    Content is read once: what is left of a document is a row of a checkpoint with its digest, its findings and its candidates
    for cards, under a number of its own. Positions are worked out from narrow rows, by that number."""
    own = C.withhold(documents, max_bytes=max_bytes)
    own = C.with_tier(own, overrides, default_tier) if overrides is not None else own.withColumn("trust_tier", F.lit(default_tier))
    own = own if run_id is None else own.withColumn("run_id", F.lit(run_id))
    placed = "position" in own.columns
    facts = ["run_id", *(["position"] if placed else []), "source", "trust_tier", "sha256", "withheld", "reason", "bytes"]
    own = own.withColumn("bytes", F.octet_length("content")).select(*facts, F.monotonically_increasing_id().alias("_doc"), "text")
    once = cut(C.candidates(T.redact(own).drop("text"), max_cards))
    told = once.select(*facts, "_doc", F.when(~F.col("withheld"), F.col("findings")).alias("findings"))
    if not placed:
        told = ordinals(told.withColumn("_one", F.lit(1)), "run_id", ["source", "sha256"], "_one").withColumnRenamed("ordinal", "position").drop("before", "_one")
    told = cut(told)
    held = told.select("run_id", "position", "source", "trust_tier", "sha256", "withheld", "reason", "bytes")
    cards = C.ranked(once.where("not withheld").drop("position", "withheld", "reason", "bytes"), max_cards, key="_doc")
    cards = cut(cards.join(told.select("_doc", "position"), "_doc").drop("_doc"))
    numbered, inputs = render.numbered(cards, held, key="position", kept=True)
    findings = told.where("not withheld").select("run_id", "position", "findings")
    return Run(held, cards, render.summary(numbered, inputs), manifest(held, cards), findings, inputs.select("run_id", "position", "ordinal", "_n", "before"))


def manifest(documents: DataFrame, cards: DataFrame) -> DataFrame:
    """A row for each run: its inputs in order, counts, and whether its tiers are mixed."""
    inputs = documents.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "source", "sha256", "bytes", "trust_tier", "withheld"))), lambda x: x.dropFields("position")).alias("inputs"),
        F.count("*").alias("documents"), F.count_if("withheld").alias("withheld_documents"), (F.count_distinct("trust_tier") > 1).alias("mixed_trust_tiers"),
    )
    n = cards.groupBy("run_id").agg(F.count("*").alias("cards"))
    return inputs.join(n, "run_id", "left").withColumn("cards", F.coalesce("cards", F.lit(0)))


def hook(calls: DataFrame, cache: DataFrame, surfaces: dict[str, bool], minimum_tokens: int = 600, minimum_savings: float = 0.25, max_cards: int = 24) -> DataFrame:
    """What becomes of tool answers (call_id, surface, tool, text): ``outcome`` and the text to hand on.

    bypass: the surface is off, the answer is short, or condensing would not save enough (savings are rounded to four
    places first); hit: the cache (entry_key, summary) has it under the same settings; miss: condensed now. Text that
    cannot be read is withheld. A call is one row, however often the cache has a key (of several summaries the least counts).
    """
    on = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in surfaces.items() for x in kv]), F.col("surface")), F.lit(False))
    own = calls.withColumn("tokens", T.token_count("text")).withColumn("entry_key", T.entry_key(T.digest("text"), hook_settings(max_cards, minimum_savings)))
    own = own.withColumn("_wanted", on & (F.col("tokens") >= minimum_tokens) & F.col("text").isNotNull()).join(cache.groupBy("entry_key").agg(F.min("summary").alias("_cached")), "entry_key", "left")
    fresh = own.where("_wanted and _cached is null").select("call_id", F.col("call_id").cast("string").alias("run_id"), F.col("tool").alias("trust_tier"), "text", T.digest("text").alias("sha256"), F.lit("task-return").alias("source"))
    cards = C.cards(T.redact(fresh).drop("text"), max_cards, key="call_id")
    made = render.summary(*render.numbered(cards, fresh, key="call_id")).select(F.col("run_id").alias("_run"), F.col("summary").alias("_made"))
    both = own.join(made, own["call_id"].cast("string") == F.col("_run"), "left")
    new = F.coalesce("_cached", "_made")
    saved = round4(T.savings(F.col("tokens"), T.token_count(new))) >= minimum_savings
    outcome = F.when(F.col("text").isNull(), "withheld").when(~F.col("_wanted"), "bypass").when(~saved, "bypass").when(F.col("_cached").isNotNull(), "hit").otherwise("miss")
    return both.withColumn("outcome", outcome).select("call_id", "tokens", "outcome", F.when(F.col("outcome").isin("hit", "miss"), new).when(F.col("outcome") == "bypass", F.col("text")).alias("handed_on"))


def hook_settings(max_cards: int = 24, minimum_savings: float = 0.25) -> Column:
    """What a cached summary depends on besides the text, its tool's tier too: part of its key."""
    return F.concat(F.lit('{"max_cards":%d,"min_savings":%s,"tier":"' % (max_cards, minimum_savings)), F.coalesce("tool", F.lit("")), F.lit('"}'))
