"""Reports over ledgers of many runs: which ledgers may share a report, and what its cohorts spent and saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.operators import ledger

#: What a ledger row says of its run, one boolean each, beside ``withheld_documents`` and ``input_tokens``.
FLAGS = ("handoff_pass", "recall_measured", "recall_loss", "toon_eligible", "toon_selected")
#: Measures of all runs of a cohort, and those of the runs that count for savings.
OPERATIONAL = ("documents", "emitted_cards", "engine_wall_ms", "input_bytes", "input_tokens", "run_wall_ms", "withheld_documents")
HANDOFFS = ("summary", "cards", "toon")
ECONOMIC = tuple(f"{h}_{x}" for h in HANDOFFS for x in ("bytes", "tokens", "byte_savings", "token_savings"))


def gates(ledgers: DataFrame, report: str, cohort: list[str]) -> DataFrame:
    """A row for each report: ledgers, unique_spools, estimators, repeated (spools that come again within a cohort) and the
    status: refused, insufficient-corpus or pass. Needs ``spool`` and ``estimator``. A null report is one of its own."""
    spools = ledgers.groupBy(report, "spool", *cohort).agg(F.count("*").alias("_n"), F.min("estimator").alias("_low"), F.max("estimator").alias("_high"), F.count_if(F.col("estimator").isNull()).alias("_none"))
    # one estimator: the smallest is the largest, and no ledger lacks one
    one = F.coalesce(F.min("_low") == F.max("_high"), F.lit(False)) & (F.sum("_none") == 0)
    out = spools.groupBy(report).agg(F.sum("_n").alias("ledgers"), F.count_distinct("spool").alias("unique_spools"), F.count_if(F.col("_n") > 1).alias("repeated"), one.alias("one_estimator"))
    return out.withColumn("status", ledger.gate_status(F.col("ledgers"), F.col("unique_spools"), F.col("repeated"), F.col("one_estimator")))


def _saved(base: str, other: str) -> Column:
    return F.when(F.col(base) > 0, (F.col(base) - F.col(other)) / F.col(base))


def eligible_runs(ledgers: DataFrame) -> DataFrame:
    """``ledgers`` with ``economic`` (no document withheld and some input) and the savings of each hand-off against the raw
    input, null where there is no hand-off. Savings are not rounded."""
    own = ledgers.withColumn("economic", (F.col("withheld_documents") == 0) & (F.col("input_tokens") > 0))
    return own.withColumns({f"{h}_{one}_savings": _saved(f"input_{many}", f"{h}_{many}") for h in HANDOFFS for one, many in (("byte", "bytes"), ("token", "tokens"))})


def accepted(ledgers: DataFrame, gate: DataFrame, report: str) -> DataFrame:
    """The ledgers of reports that are not refused: at most ``ledger.MAXIMUM_LEDGERS`` each."""
    some = gate.where("status <> 'refused'").select(F.col(report).alias("_r"))
    return ledgers.join(some, F.col(report).eqNullSafe(F.col("_r")), "left_semi")


def cohort_rows(ledgers: DataFrame, report: str, cohort: list[str]) -> DataFrame:
    """A row for each cohort of each report that is not refused: how many runs, the share of each flag, which runs are
    left out of savings and why, whether there are enough runs for percentiles, and savings weighted by size.

    Savings of the row-encoded hand-off (``toon_*``) are over the runs that have one only, against those runs' input."""
    own = eligible_runs(accepted(ledgers, gates(ledgers, report, cohort), report))
    e, t = F.col("economic"), F.col("economic") & F.col("toon_tokens").isNotNull()
    enough = lambda n: F.when(n >= ledger.FEW, "pass").otherwise("insufficient-cohort")

    def weighted(h: str, x: str) -> Column:
        of = t if h == "toon" else e
        base, other = F.sum(F.when(of, F.col(f"input_{x}"))), F.sum(F.when(of, F.col(f"{h}_{x}")))
        return F.when(base > 0, (base - other) / base).alias(f"{h}_{x[:-1]}_savings")

    return own.groupBy(report, *cohort).agg(
        F.count("*").alias("runs"), enough(F.count("*")).alias("percentiles"), *[(F.count_if(F.col(f)) / F.count("*")).alias(f"{f}_rate") for f in FLAGS],
        (F.count_if(~F.col("recall_measured")) / F.count("*")).alias("legacy_unmeasured_rate"),
        (F.count_if(F.col("withheld_documents") > 0) / F.count("*")).alias("withheld_rate"), F.when(F.sum("documents") > 0, F.sum("withheld_documents") / F.sum("documents")).alias("withheld_documents_rate"),
        F.count_if(e).alias("economic_runs"), enough(F.count_if(e)).alias("economic_percentiles"), F.count_if(t).alias("toon_runs"),
        F.count_if(F.col("withheld_documents") > 0).alias("excluded_withheld"), F.count_if((F.col("withheld_documents") == 0) & (F.col("input_tokens") == 0)).alias("excluded_without_input"),
        *[weighted(h, x) for h in HANDOFFS for x in ("bytes", "tokens")],
    )


def cohort_measures(ledgers: DataFrame, report: str, cohort: list[str]) -> DataFrame:
    """(report, cohort, measure, n, low, high, p50, p90, values): each measure of each cohort of the reports that are not
    refused; those of ECONOMIC over the runs that count for savings. From ``ledger.FEW`` values on nearest-rank percentiles,
    below that the sorted values. A refused report's ledgers go before anything is gathered, so a group holds few."""
    own = eligible_runs(accepted(ledgers, gates(ledgers, report, cohort), report))
    keys = [report, *cohort]
    values = lambda names: F.struct(*[F.col(m).cast("double").alias(m) for m in names])
    # a row a run and not one a measure: a cohort's runs are no more than a report may have
    runs = own.groupBy(*keys).agg(F.collect_list(values(OPERATIONAL)).alias("_all"), F.collect_list(F.when(F.col("economic"), values(ECONOMIC))).alias("_some"))
    item = lambda m, of: F.struct(F.lit(m).alias("measure"), F.array_sort(F.filter(F.transform(of, lambda x: x[m]), lambda v: v.isNotNull())).alias("v"))
    some = F.when(F.size("_some") > 0, F.array(*[item(m, "_some") for m in ECONOMIC])).otherwise(F.array().cast("array<struct<measure:string,v:array<double>>>"))
    rows = runs.select(*keys, F.explode(F.concat(F.array(*[item(m, "_all") for m in OPERATIONAL]), some)).alias("_x")).select(*keys, "_x.*")
    n = F.size("v")
    rank = lambda tenths: F.when(n >= ledger.FEW, F.get("v", F.expr(f"cast((size(v) * {tenths} + 9) div 10 as int) - 1")))
    return rows.select(*keys, "measure", n.cast("long").alias("n"), F.get("v", F.lit(0)).alias("low"), F.get("v", n - 1).alias("high"), rank(5).alias("p50"), rank(9).alias("p90"), F.when((n > 0) & (n < ledger.FEW), F.col("v")).alias("values"))
