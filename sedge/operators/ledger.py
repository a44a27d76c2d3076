"""Efficiency of condensed hand-offs: artifact sizes, hand-off totals, the gate, and statistics of cohorts of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as T

#: Which artifacts each hand-off is made of; an artifact may be in several.
HANDOFFS = {"summary_only": ("summary",), "summary_plus_authoritative_cards": ("summary", "cards"), "summary_plus_toon_compact_view": ("summary", "toon")}
#: Fewer measured runs than this are listed one by one instead of by percentiles.
FEW = 5


def artifact_sizes(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """bytes, tokens and records for each artifact."""
    return texts.groupBy(*by).agg(F.sum(F.octet_length(text)).alias("bytes"), F.sum(T.token_count(text)).alias("tokens"), F.count("*").alias("records"))


def handoff_totals(sizes: DataFrame, run: str = "run_id") -> DataFrame:
    """Sizes added up for each hand-off whose artifacts a run has all of (sizes: run, artifact, bytes, tokens)."""
    groups = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("handoff"), F.lit(i).alias("position"), F.array(*map(F.lit, v)).alias("of"), F.lit(len(v)).alias("needs")) for i, (k, v) in enumerate(HANDOFFS.items())]), lambda g: F.array_contains(g.of, F.col("artifact"))))
    own = sizes.withColumn("_g", groups)
    return own.groupBy(run, F.col("_g.handoff").alias("handoff"), F.col("_g.position").alias("position"), F.col("_g.needs").alias("_needs")).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count_distinct("artifact").alias("_has")).where("_has = _needs").drop("_has", "_needs")


def best_handoffs(totals: DataFrame, run: str = "run_id", eligible: str = "eligible") -> DataFrame:
    """best_measured: fewest tokens, earlier hand-off on ties; recommended: fewest of the eligible, by name on ties."""
    return totals.groupBy(run).agg(
        F.min_by("handoff", F.struct("tokens", "position")).alias("best_measured"),
        F.min_by(F.when(F.col(eligible), F.col("handoff")), F.when(F.col(eligible), F.struct("tokens", "handoff"))).alias("recommended"),
    )


def gate(withheld: Column, savings: Column, lost: Column, minimum: float = 0.25) -> Column:
    """withheld, then recall loss where savings would pass, then the threshold; savings are compared unrounded."""
    meets = F.coalesce(savings >= minimum, F.lit(False))
    return F.when(withheld > 0, "withheld").when(meets & (lost == 0), "pass").when(lost > 0, "recall-loss").otherwise("below-threshold")


def cohort_stats(records: DataFrame, key: list[str], measure: str) -> DataFrame:
    """count, min, max, nearest-rank p50 and p90 (from FEW values on) of a measure for each cohort."""
    pick = lambda p: F.expr(f"case when count(`{measure}`) >= {FEW} then percentile_disc({p}) within group (order by `{measure}`) end")
    return records.groupBy(*key).agg(F.count(measure).alias("n"), F.min(measure).alias("low"), F.max(measure).alias("high"), pick(0.5).alias("p50"), pick(0.9).alias("p90"))


def few_values(records: DataFrame, key: list[str], measure: str) -> DataFrame:
    """(key, values): the sorted values of cohorts of fewer than FEW; larger ones go after a count, before they are dealt out."""
    own = records.where(F.col(measure).isNotNull()).select(*key, measure)
    small = own.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count("*").alias("_n")).where(F.col("_n") < FEW)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return own.join(small, same, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(measure)).alias("values"))


def cohort_rates(records: DataFrame, key: list[str], flags: list[str], base: str, candidate: str, eligible: str) -> DataFrame:
    """Rates of boolean flags, and savings weighted by size over the eligible runs."""
    rates = [(F.count_if(F.col(f)) / F.count("*")).alias(f"{f}_rate") for f in flags]
    b, c = (F.sum(F.when(F.col(eligible), F.col(x))) for x in (base, candidate))
    return records.groupBy(*key).agg(F.count("*").alias("runs"), *rates, F.count_if(~F.col(eligible)).alias("excluded"), F.when(b > 0, (b - c) / b).alias("weighted_savings"))


def cohort_id(*cols: Column) -> Column:
    """16 hex digits of the compact JSON of the key with sorted names (strings only)."""
    from sedge.functions.udfs import canonical_json

    return F.substring(F.sha2(canonical_json(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})), 256), 1, 16)


def tree_digest(rows: DataFrame, by: list[str], line: Column, place: Column, order: list[str], fan: int = 1000, levels: int = 3) -> DataFrame:
    """(by, digest, n): SHA-256 of a group of any size. Lines are taken in ``order`` within each run of ``fan`` places (a
    whole number that does not fall as the order goes on), then the runs' digests by ``fan``, and so on; the last level
    takes what is left, so no row holds more than about ``fan`` lines or digests, if places are as dense as rows."""
    own = rows.select(*by, F.floor(place / fan).cast("long").alias("_at"), F.struct(*order, line.alias("_line")).alias("_s"))
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_line"]), "\n"), 256).alias("_line")
    now = own.groupBy(*by, "_at").agg(joined(), F.count("*").alias("n"))
    for level in range(1, levels):
        up = F.floor(F.col("_at") / fan).cast("long") if level < levels - 1 else F.lit(0).cast("long")
        now = now.select(*by, up.alias("_up"), F.struct("_at", "_line").alias("_s"), "n").groupBy(*by, F.col("_up").alias("_at")).agg(joined(), F.sum("n").alias("n"))
    return now.select(*by, F.col("_line").alias("digest"), "n")


def repeats(records: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; a report over such records is refused."""
    return records.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def violations(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``records`` with ``errors``: the sorted names of the rules that do not hold (a null outcome does not hold)."""
    return records.withColumn("errors", F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))))


# What a ledger's limits must be, and how many distinct spools a report needs and takes.
LIMITS = {"documents": 64, "input_bytes_per_document": 2_000_000, "aggregate_input_bytes": 16 * 1024 * 1024, "wall_clock_budget_ms": 2000}
CARDS_PER_DOCUMENT = 24
MINIMUM_SPOOLS, MAXIMUM_LEDGERS = 20, 50
#: Which execution shape and budget go with each engine.
SHAPES = {"python": ("python-sequential-oracle", "bounded-input-only-python-oracle"), "chapel": ("chapel-one-shot-coforall-batch", "chapel-wall-clock-withholding")}


def spool_rules() -> dict[str, Column]:
    """Rules over a ledger row: execution, spool (documents, inputs' bytes, cards, withheld), limits, artifacts and the row
    encoding. To be given to :func:`violations`."""
    c = F.col
    pair = F.struct("shape", "budget_enforcement")
    supported = [(c("engine") == e) & (pair == F.struct(F.lit(a).alias("shape"), F.lit(b).alias("budget_enforcement"))) for e, (a, b) in SHAPES.items()]
    some = lambda name: c(f"artifacts.{name}")
    return {
        "execution-cohort": supported[0] | supported[1],
        "run-covers-engine": (c("engine_wall_ms") >= 0) & (c("run_wall_ms") >= c("engine_wall_ms")),
        "documents-of-identity": (c("documents") >= 1) & (c("documents") == F.size("input_bytes_each")),
        "withheld-within-documents": (c("withheld_documents") >= 0) & (c("withheld_documents") <= c("documents")),
        "withheld-detailed": F.size("withheld") == c("withheld_documents"),
        "withheld-named": F.forall("withheld", lambda w: (w.source != "") & (w.reason != "")),
        "input-bytes-of-identity": c("input_bytes") == F.aggregate("input_bytes_each", F.lit(0).cast("long"), lambda a, x: a + x),
        "input-tokens": c("input_tokens") >= 0,
        **{f"limit-{name}".replace("_", "-"): c(f"limits.{name}") == value for name, value in LIMITS.items()},
        "within-limits": (c("documents") <= LIMITS["documents"]) & (c("input_bytes") <= LIMITS["aggregate_input_bytes"]),
        "inputs-within-limit": F.forall("input_bytes_each", lambda x: x <= LIMITS["input_bytes_per_document"]),
        "limit-cards": c("limits.cards_per_document").between(1, CARDS_PER_DOCUMENT),
        "cards-within-limit": (c("emitted_cards") >= 0) & (c("emitted_cards") <= c("documents") * c("limits.cards_per_document")),
        "no-raw-copies": ~c("raw_inputs_copied"),
        "card-records": c("card_records") == c("emitted_cards"),
        "artifact-sizes": (some("summary").bytes >= 0) & (some("summary").tokens >= 0) & (some("cards").bytes >= 0) & (some("cards").tokens >= 0),
        "artifact-digests": some("summary").sha256.rlike(r"\A[0-9a-f]{64}\z") & some("cards").sha256.rlike(r"\A[0-9a-f]{64}\z"),
        "toon-null-without-cards": c("toon_savings").isNotNull() | ((c("emitted_cards") == 0) & ~c("toon_selected") & ~c("toon_eligible")),
        "toon-savings": F.coalesce(c("toon_savings") <= 1, F.lit(True)),
        "toon-selected-if-eligible": c("toon_selected") == c("toon_eligible"),
        "toon-of-cards": ~c("toon_selected") | ((some("cards").bytes > 0) & (some("cards").tokens > 0)),
    }


def gate_status(ledgers: Column, unique_spools: Column, repeated: Column, one_estimator: Column) -> Column:
    """refused (none, too many, repeated or mixed estimators), insufficient-corpus, or pass."""
    refused = (ledgers == 0) | (ledgers > MAXIMUM_LEDGERS) | (repeated > 0) | ~one_estimator
    return F.when(refused, "refused").when(unique_spools >= MINIMUM_SPOOLS, "pass").otherwise("insufficient-corpus")
