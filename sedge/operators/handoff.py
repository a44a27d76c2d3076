"""Which hand-off of a run is recommended, from sizes and recall, and the rules that a ledger's hand-offs must keep.

A row is a ledger: ``input_bytes``, ``input_tokens``, ``withheld_documents``, ``minimum`` (the least savings), ``toon_selected``,
``measured`` (the ledger is of a version that measures recall), ``artifacts`` (name to bytes and tokens), ``handoffs`` (name to
bytes, tokens, byte_savings, token_savings), ``recall`` (recognized, total, handoffs: name to retained, retained_total,
status; null if not measured) and ``decision`` (what :func:`decide` gives). Everything is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.spread import cut
from sedge.functions.udfs import round4
from sedge.operators.ledger import HANDOFFS

# What is recalled, and what a gate may say.
KINDS = ("critical_constraints", "open_questions")
GATES = ("pass", "below-threshold", "withheld")
_COMPACT = "summary_plus_toon_compact_view"


def names() -> Column:
    """The hand-offs that a row must have, in order: the compact one only where it was selected."""
    every = F.array(*map(F.lit, HANDOFFS))
    return F.when(F.col("toon_selected"), every).otherwise(F.filter(every, lambda n: n != _COMPACT))


def _of(name: Column, field: str) -> Column:
    return F.col("handoffs")[name][field]


def _kept(name: Column, kind: str) -> Column:
    return F.col("recall.handoffs")[name]["retained"][kind]


def _known(kind: str) -> Column:
    return F.col("recall.recognized")[kind]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def status(name: Column) -> Column:
    """How a hand-off's recall comes out by its counts; null where recall is not measured."""
    full = F.coalesce(_all([_kept(name, k) == _known(k) for k in KINDS]), F.lit(False))
    return F.when(F.col("recall").isNotNull(), F.when(F.col("recall.total") == 0, "not-applicable").when(full, "pass").otherwise("recall-loss"))


def decide() -> Column:
    """savings_eligible (by name; null where recall is not measured), eligible, best (fewest tokens, the earlier on ties),
    recommended (fewest of the eligible, by name on ties) and the gate; with documents withheld only the first is left."""
    size = F.col("input_tokens")
    saves = F.array_sort(F.filter(names(), lambda n: F.coalesce((size > 0) & ((size - _of(n, "tokens")) / size >= F.col("minimum")), F.lit(False))))
    kept = F.filter(saves, lambda n: ~status(n).eqNullSafe(F.lit("recall-loss")))
    measured, held = F.col("recall").isNotNull(), F.col("withheld_documents") > 0
    best = F.array_min(F.transform(names(), lambda n, i: F.struct(_of(n, "tokens").alias("t"), i.alias("i"), n.alias("n"))))["n"]
    first = F.array_min(F.transform(kept, lambda n: F.struct(_of(n, "tokens").alias("t"), n.alias("n"))))["n"]
    gate = F.when(held, "withheld").when(F.size(kept) > 0, "pass").when(measured & (F.size(saves) > 0), "recall-loss").otherwise("below-threshold")
    none = F.array().cast("array<string>")
    return F.struct(F.when(measured, saves).alias("savings_eligible"), F.when(held, none).otherwise(kept).alias("eligible"), F.when(~held, best).alias("best"), F.when(~held, first).alias("recommended"), gate.alias("gate"))


def decided(rows: DataFrame, to: str) -> DataFrame:
    """``rows`` with :func:`decide` as the column ``to``. Its fields are columns first, each worked out once: fields of one
    struct are written out again wherever they are read."""
    want, fields = decide(), ("savings_eligible", "eligible", "best", "recommended", "gate")
    own = cut(rows.withColumns({f"_w.{x}": want[x] for x in fields}))
    return own.withColumn(to, F.struct(*[F.col(f"`_w.{x}`").alias(x) for x in fields])).drop(*[f"_w.{x}" for x in fields])


def rules(decision: str | None = None) -> dict[str, Column]:
    """Rules for :func:`sedge.operators.ledger.violations`; ``decision``: where :func:`decided` has put it, if it has."""
    has, recall, said = names(), F.col("recall"), F.col("decision")
    each = lambda f: F.forall(has, f)
    same_names = lambda m: F.array_sort(F.map_keys(m)) == F.array_sort(has)
    parts = F.create_map(*[x for n, of in HANDOFFS.items() for x in (F.lit(n), F.array(*map(F.lit, of)))])
    total = lambda n, x: F.aggregate(parts[n], F.lit(0).cast("long"), lambda a, p: a + F.col("artifacts")[p][x])
    # a UDF's arguments are computed for every row, so the divisor itself is null where there is no input
    saved = lambda size, n, x: round4((F.col(size) - _of(n, x)) / F.when(F.col(size) > 0, F.col(size)))
    measured = lambda ok: recall.isNull() | ok
    want = F.col(decision) if decision else decide()
    right = lambda field: said[field].eqNullSafe(want[field])
    shown = {n: F.lit(n) for n in HANDOFFS}
    savings = lambda size, x, to: _all([~F.array_contains(has, n) | _of(c, to).eqNullSafe(saved(size, c, x)) for n, c in shown.items()])
    counts = lambda n: [(_kept(n, k) >= 0) & (_kept(n, k) <= _known(k)) for k in KINDS]
    return {
        "handoff-names": same_names(F.col("handoffs")),
        "handoff-bytes": each(lambda n: _of(n, "bytes") == total(n, "bytes")), "handoff-tokens": each(lambda n: _of(n, "tokens") == total(n, "tokens")),
        "handoff-byte-savings": savings("input_bytes", "bytes", "byte_savings"), "handoff-token-savings": savings("input_tokens", "tokens", "token_savings"),
        "recall-of-version": F.col("measured") == recall.isNotNull(),
        "recall-recognized": measured((F.array_sort(F.map_keys("recall.recognized")) == F.array(*map(F.lit, KINDS))) & _all([_known(k) >= 0 for k in KINDS])),
        "recall-recognized-total": measured(F.col("recall.total") == sum(_known(k) for k in KINDS)),
        "recall-handoffs": measured(same_names(F.col("recall.handoffs"))),
        "recall-retained": measured(each(lambda n: _all(counts(n)))),
        "recall-retained-total": measured(each(lambda n: F.col("recall.handoffs")[n]["retained_total"] == sum(_kept(n, k) for k in KINDS))),
        "recall-status": measured(each(lambda n: F.col("recall.handoffs")[n]["status"] == status(n))),
        "decision-minimum": F.col("minimum").between(0, 1),
        "decision-gate": said["gate"].isin(*GATES) | (recall.isNotNull() & (said["gate"] == "recall-loss")),
        "decision-withheld": (F.col("withheld_documents") > 0) == (said["gate"] == "withheld"),
        **{f"decision-{x}".replace("_", "-"): right(x) for x in ("savings_eligible", "eligible", "best", "recommended")},
        "decision-gate-of-counts": right("gate"),
    }
