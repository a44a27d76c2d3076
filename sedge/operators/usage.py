"""Usage records of model calls: checks, merges, roll-ups and comparisons. A null is unknown, never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def rollup(rows: DataFrame, by: list[str], amount: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("events"), F.sum(amount).alias("total"), F.count(amount).alias("known"))


def last_write(rows: DataFrame, by: list[str], fields: list[str], pos: str) -> DataFrame:
    """Each field's last value that is not null, by position."""
    return rows.groupBy(*by).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(pos))).alias(f) for f in fields])


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``errors`` and ``omitted_fields``: input tokens must be known, parts must not exceed wholes, and a
    known total must be the sum of known parts."""
    c = F.col
    rules = {
        "input-unknown": c("input_tokens").isNotNull(),
        "negative": ~F.greatest(*[F.coalesce(c(f) < 0, F.lit(False)) for f in FIELDS]),
        "cached-over-input": F.coalesce(c("cached_input_tokens") <= c("input_tokens"), F.lit(True)),
        "reasoning-over-output": F.coalesce(c("reasoning_output_tokens") <= c("output_tokens"), F.lit(True)),
        "total-mismatch": F.coalesce(c("total_tokens") == c("input_tokens") + c("output_tokens"), F.lit(True)),
    }
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return rows.withColumn("errors", errors).withColumn("omitted_fields", F.array_compact(F.array(*[F.when(c(f).isNull(), F.lit(f)) for f in FIELDS])))


def compare(rows: DataFrame, bind: list[str], differ: list[str]) -> DataFrame:
    """Baseline and candidate rows (``variant``) that agree on ``bind`` and differ in all of ``differ``, with the savings
    of each field; a field unknown on either side has unknown savings."""
    keep = [*bind, *differ, *FIELDS]
    a = rows.where("variant = 'baseline'").select(*[F.col(x) if x in bind else F.col(x).alias(f"base_{x}") for x in keep])
    b = rows.where("variant = 'candidate'").select(*[F.col(x) if x in bind else F.col(x).alias(f"cand_{x}") for x in keep])
    both = a.join(b, bind)
    for d in differ:
        both = both.where(F.col(f"base_{d}") != F.col(f"cand_{d}"))
    return both.withColumns({f"{f}_savings": F.when(F.col(f"base_{f}") > 0, (F.col(f"base_{f}") - F.col(f"cand_{f}")) / F.col(f"base_{f}")) for f in FIELDS})
