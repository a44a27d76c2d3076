"""Verdicts on condensed runs held against what was expected of them, a row a case, and the report over all cases.

A case's artifacts come as rows: ``cards``, the lines of its texts by where they stand, its inputs and the inputs that its
manifest lists. Rows meet by case, and what meets is folded at once, so nothing of a case is gathered but its failures. An
expectation is a text without line breaks, so that a line holds it if the whole text does. Pairs are a case's expectations
times its cards and lines; both are bounded by policy (64 documents of 24 cards).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = "[REDACTED]"
#: Kinds of expectations: the dimension they belong to and how a failure of one is named.
KINDS = {
    "constraints": ("constraints", "constraints.missing"), "forbidden_constraints": ("constraints", "constraints.forbidden"), "open_questions": ("open_questions", "open_questions.missing"),
    "redacted_claims": ("redaction", "redaction.required_claim_missing"), "forbidden_fragments": ("redaction", "redaction.forbidden_fragment"), "clean_claims": ("redaction", "redaction.clean_claim_missing"),
    "claim_provenance": ("provenance", "provenance.claim_binding"),
}
DIMENSIONS = ("constraints", "open_questions", "redaction", "provenance")
#: Where a line stands: in a section of the summary, elsewhere in it, or in another artifact that a model reads.
PLACES = ("critical", "question", "summary", "other")


def _numbered(name: str, at: str = "at") -> Column:
    return F.format_string(f"{name}[%d]", at)


def anchors(expected: DataFrame, cards: DataFrame, lines: DataFrame) -> DataFrame:
    """(case_id, kind, at, met): each expectation of KINDS and whether the case meets it.

    Constraints and questions must stand in their section and in a card; forbidden constraints in no critical line; masked
    claims in the summary and only in cards flagged ``redacted``, one at least; forbidden fragments nowhere; clean claims in
    the summary and in a card; bound claims in a card, and in none of another source or other lines.
    """
    card = cards.select("case_id", F.lit("card").alias("place"), F.col("claim").alias("line"), F.array_contains("flags", "redacted").alias("redacted"), F.col("source").alias("_s"), F.col("line_start").alias("_a"), F.col("line_end").alias("_z"))
    more = cards.select("case_id", F.lit("other").alias("place"), F.col("evidence").alias("line"))
    rows = card.unionByName(lines.select("case_id", "place", "line").unionByName(more), allowMissingColumns=True)
    own = expected.where(F.col("kind").isin(*KINDS)).withColumnsRenamed({"text": "_t", "source": "_es", "line_start": "_ea", "line_end": "_ez"})
    # what does not hold is left out in the join itself: a pair costs a search, not a row
    rows = rows.withColumnRenamed("case_id", "_case")
    met = own.join(rows, (F.col("case_id") == F.col("_case")) & F.col("line").contains(F.col("_t")), "left").select("case_id", "kind", "at", F.col("_case").isNotNull().alias("h"), F.coalesce("place", F.lit("")).alias("place"), F.coalesce("redacted", F.lit(False)).alias("redacted"), (F.col("_s").eqNullSafe(F.col("_es")) & F.col("_a").eqNullSafe(F.col("_ea")) & F.col("_z").eqNullSafe(F.col("_ez"))).alias("bound"))
    some = lambda c: F.coalesce(F.bool_or(F.col("h") & c), F.lit(False))
    is_card = F.col("place") == "card"
    found = met.groupBy("case_id", "kind", "at").agg(
        some(is_card).alias("card"), some(is_card & ~F.col("redacted")).alias("open"), some(is_card & ~F.col("bound")).alias("astray"), some(F.col("place") == "critical").alias("critical"),
        some(F.col("place") == "question").alias("question"), some(F.col("place").isin("critical", "question", "summary")).alias("summary"), some(F.lit(True)).alias("any"),
    )
    c = F.col
    rules = {
        "constraints": c("critical") & c("card"), "forbidden_constraints": ~c("critical"), "open_questions": c("question") & c("card"), "redacted_claims": c("card") & ~c("open") & c("summary"),
        "forbidden_fragments": ~c("any"), "clean_claims": c("summary") & c("card"), "claim_provenance": c("card") & ~c("astray"),
    }
    outcome = reduce(lambda out, kind: out.when(c("kind") == kind, rules[kind]), rules, F.when(F.lit(False), F.lit(False)))
    return found.select("case_id", "kind", "at", outcome.alias("met"))


def clean_failures(expected: DataFrame, cards: DataFrame, lines: DataFrame, inputs: DataFrame) -> DataFrame:
    """(case_id, dimension, code): cards of sources that must be clean but hold a mask or its flag, and masks anywhere in a
    case whose sources must all be clean."""
    clean = expected.where("kind = 'clean_sources'").select("case_id", "source").distinct()
    masked = lambda c: F.coalesce(F.col(c).contains(MASK), F.lit(True))
    bad = F.coalesce(F.array_contains("flags", "redacted"), F.lit(True)) | masked("claim") | masked("evidence")
    one = cards.join(clean, ["case_id", "source"], "left_semi").where(bad).select("case_id", _numbered("redaction.clean_source_violation").alias("code"))
    names = inputs.select("case_id", "source").distinct().join(clean.withColumn("_c", F.lit(1)), ["case_id", "source"], "left")
    whole = names.groupBy("case_id").agg(F.count("*").alias("_n"), F.count("_c").alias("_m")).where("_n = _m")
    both = lines.select("case_id", "line").unionByName(cards.select("case_id", F.explode(F.array("claim", "evidence")).alias("line")))
    marked = both.where(F.col("line").contains(MASK)).select("case_id").distinct()
    every = whole.join(marked, "case_id", "left_semi").select("case_id", F.lit("redaction.clean_artifact_violation").alias("code"))
    return one.unionByName(every).select("case_id", F.lit("redaction").alias("dimension"), "code")


def provenance_failures(cards: DataFrame, inputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(case_id, dimension, code): inputs that a manifest leaves out, repeats, does not know or has other digests, sizes or
    tiers of; cards of unknown sources, of other digests and tiers, or of lines that their source has not. A manifest with
    another number of inputs is not looked at further."""
    fail = lambda df, code: df.select("case_id", code.alias("code"))
    names = inputs.select("case_id", "source", *[F.col(x).alias(f"_{x}") for x in ("sha256", "bytes", "trust_tier", "lines")], F.lit(True).alias("_known"))
    count = lambda df, n: df.groupBy("case_id").agg(F.count("*").alias(n))
    n = count(inputs, "_n").join(count(manifest, "_m"), "case_id", "left").withColumn("_ok", F.coalesce(F.col("_n") == F.col("_m"), F.lit(False)))
    listed = manifest.join(n.where("_ok").select("case_id"), "case_id", "left_semi").join(names, ["case_id", "source"], "left")
    nth = F.row_number().over(Window.partitionBy("case_id", "source").orderBy("at"))
    listed = listed.withColumn("_first", F.col("_known").isNotNull() & (nth == 1))
    differs = lambda *cols: reduce(lambda a, b: a | b, [~F.col(x).eqNullSafe(F.col(f"_{x}")) for x in cols])
    some = count(listed.where("_first"), "_r")
    held = cards.join(names, ["case_id", "source"], "left")
    in_text = F.coalesce((F.col("line_start") >= 1) & (F.col("line_start") <= F.col("line_end")) & (F.col("line_end") <= F.col("_lines")), F.lit(False))
    shown = held.where("_known").groupBy("case_id").agg(F.count_distinct("source").alias("_r"))
    short = lambda df: n.join(df, "case_id", "left").where("coalesce(_r, 0) <> _n")
    out = [
        fail(n.where("NOT _ok"), F.lit("provenance.manifest_input_count")), fail(listed.where("NOT _first"), _numbered("provenance.manifest_source")),
        fail(listed.where(F.col("_first") & differs("sha256", "bytes", "trust_tier")), _numbered("provenance.manifest_metadata")), fail(short(some), F.lit("provenance.manifest_sources_incomplete")),
        fail(held, F.when(F.col("_known").isNull(), _numbered("provenance.card_source")).when(differs("sha256", "trust_tier") | ~in_text, _numbered("provenance.card_metadata"))).where("code IS NOT NULL"),
        fail(short(shown), F.lit("provenance.card_sources_incomplete")),
    ]
    return reduce(DataFrame.unionByName, out).select("case_id", F.lit("provenance").alias("dimension"), "code")


def reopen_failures(cases: DataFrame, lines: DataFrame, reopen: tuple[str, ...]) -> DataFrame:
    """(case_id, dimension, code) of cases whose summary lacks one of the texts ``reopen``."""
    there = lines.where("place <> 'other'").groupBy("case_id").agg(*[F.bool_or(F.coalesce(F.col("line").contains(x), F.lit(False))).alias(f"_{i}") for i, x in enumerate(reopen)])
    lack = reduce(lambda a, b: a | b, [~F.coalesce(F.col(f"_{i}"), F.lit(False)) for i in range(len(reopen))])
    return cases.join(there, "case_id", "left").where(lack).select("case_id", F.lit("provenance").alias("dimension"), F.lit("provenance.source_reopen_instructions").alias("code"))


def verdicts(cases: DataFrame, expected: DataFrame, cards: DataFrame, lines: DataFrame, inputs: DataFrame, manifest: DataFrame, reopen: tuple[str, ...]) -> DataFrame:
    """A row for each of ``cases`` (case_id): for each kind of expectation how many there are and are met, for each dimension
    ``<dimension>_applies`` and ``<dimension>_ok``, ``passed`` (all four are ok), and the sorted distinct ``failures``.

    expected: case_id, kind, at, text, source, line_start, line_end (``clean_sources`` needs the source only); cards: case_id,
    at, claim, evidence, flags, source, sha256, trust_tier, line_start, line_end; lines: case_id, place, line; inputs:
    case_id, source, sha256, bytes, trust_tier, lines, a row a source; manifest: case_id, at, source, sha256, bytes,
    trust_tier. Rows of other cases are passed over.
    """
    found = anchors(expected, cards, lines)
    kind = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])])
    code = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[1])])
    missed = found.where("NOT met").select("case_id", kind[F.col("kind")].alias("dimension"), F.format_string("%s[%d]", code[F.col("kind")], "at").alias("code"))
    failures = reduce(DataFrame.unionByName, [missed, clean_failures(expected, cards, lines, inputs), provenance_failures(cards, inputs, manifest), reopen_failures(cases, lines, reopen)])
    failed = failures.groupBy("case_id").agg(F.array_sort(F.collect_set("code")).alias("failures"), *[F.count_if(F.col("dimension") == d).alias(f"_{d}") for d in DIMENSIONS])
    of = lambda k: F.col("kind") == k
    counts = found.groupBy("case_id").agg(*[x for k in KINDS for x in (F.count_if(of(k)).alias(f"{k}_expected"), F.count_if(of(k) & F.col("met")).alias(f"{k}_met"))])
    clean = expected.where("kind = 'clean_sources'").groupBy("case_id").agg(F.count_distinct("source").alias("clean_sources"))
    sources = inputs.groupBy("case_id").agg(F.count_distinct("source").alias("sources"))
    own = reduce(lambda a, b: a.join(b, "case_id", "left"), [counts, clean, sources, failed], cases.select("case_id"))
    numbers = [f"{k}_{x}" for k in KINDS for x in ("expected", "met")] + ["clean_sources", "sources"]
    own = own.withColumns({x: F.coalesce(x, F.lit(0)) for x in numbers + [f"_{d}" for d in DIMENSIONS]}).withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))
    some = {d: [f"{k}_expected" for k, (of_d, _) in KINDS.items() if of_d == d] for d in DIMENSIONS}
    some["redaction"].append("clean_sources")
    some["provenance"] = ["sources"]
    dims = [x for d in DIMENSIONS for x in (reduce(lambda a, b: a | b, [F.col(y) > 0 for y in some[d]]).alias(f"{d}_applies"), (F.col(f"_{d}") == 0).alias(f"{d}_ok"))]
    return own.select("case_id", *numbers, *dims, (F.size("failures") == 0).alias("passed"), "failures")


def report(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """A row for each dimension (cases_total, cases_applicable, cases_passed, ok: some case applies and all that do pass) and one
    named ``gate``: all dimensions are ok, all cases pass, and ``in_order`` says that ``found`` (case_id, at, and what
    :func:`verdicts` gives) has just the cases of ``manifest`` (case_id, at) at their places. Without cases nothing is ok.

    Places are compared by value, so nothing is sorted: case by case as many times at a place on both sides."""
    sides = found.select("case_id", "at", F.lit(1).alias("_w")).unionByName(manifest.select("case_id", "at", F.lit(-1).alias("_w")))
    order = sides.groupBy("case_id", "at").agg(F.sum("_w").alias("_w")).agg((F.count_if(F.col("_w") != 0) == 0).alias("in_order"))
    rows = found.agg(F.count("*").alias("cases_total"), F.count_if("passed").alias("_passed"), *[x for d in DIMENSIONS for x in (F.count_if(f"{d}_applies").alias(f"_{d}_n"), F.count_if(F.col(f"{d}_applies") & F.col(f"{d}_ok")).alias(f"_{d}_p"))])
    both = rows.withColumn("_k", F.lit(1)).join(order.withColumn("_k", F.lit(1)), "_k")  # a row each
    n = lambda d: F.col(f"_{d}_n")
    ok = {d: (n(d) > 0) & (n(d) == F.col(f"_{d}_p")) for d in DIMENSIONS}
    whole = reduce(lambda a, b: a & b, ok.values()) & (F.col("_passed") == F.col("cases_total")) & F.col("in_order")
    line = lambda name, applies, passes, good: F.struct(F.lit(name).alias("dimension"), applies.alias("cases_applicable"), passes.alias("cases_passed"), good.alias("ok"))
    out = F.array(*[line(d, n(d), F.col(f"_{d}_p"), ok[d]) for d in DIMENSIONS], line("gate", F.col("cases_total"), F.col("_passed"), whole))
    return both.select("cases_total", "in_order", F.explode(out).alias("_x")).select("_x.*", "cases_total", "in_order")
