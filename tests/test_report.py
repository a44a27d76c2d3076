"""Reports over ledgers: which are refused, and what their cohorts say, against plain Python."""

import random
from collections import defaultdict

import pytest

from sedge.operators import ledger, report

NAMES = "report string, spool string, estimator string, cohort string, documents long, emitted_cards long, engine_wall_ms double, run_wall_ms double, withheld_documents long, input_bytes long, input_tokens long, summary_bytes long, summary_tokens long, cards_bytes long, cards_tokens long, toon_bytes long, toon_tokens long, handoff_pass boolean, recall_measured boolean, recall_loss boolean, toon_eligible boolean, toon_selected boolean"
COLUMNS = [x.split()[0] for x in NAMES.split(", ")]


def row(rng, name, spool, estimator="e", cohort="a"):
    toon = rng.random() < 0.5
    size = rng.choice([0, 40, 100, 250])
    own = [rng.randint(1, 300) for _ in range(6)]
    if not toon:
        own[4:] = [None, None]
    return (name, spool, estimator, cohort, rng.randint(1, 9), 5, 2.0, rng.random(), rng.choice([0, 0, 0, 1]), size * 4, size, *own, *(rng.random() < 0.5 for _ in range(4)), toon)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [row(rng, "fits", f"s{i}", cohort="ab"[i % 2]) for i in range(20)]
    out += [row(rng, "twice", f"s{i % 24}") for i in range(25)]
    out += [row(rng, "other cohort", f"s{i % 24}", cohort="ab"[i // 24]) for i in range(25)]
    out += [row(rng, "mixed", f"s{i}", "ef"[i == 9]) for i in range(25)] + [row(rng, "unnamed", f"s{i}", None) for i in range(25)]
    out += [row(rng, "half named", f"s{i}", "e" if i else None) for i in range(25)]
    out += [row(rng, "many", f"s{i}") for i in range(51)] + [row(rng, "most", f"s{i}") for i in range(50)]
    return out + [row(rng, None, f"s{i}", cohort=None) for i in range(3)]


def test_gates(spark, rows):
    got = {r.report: (r.ledgers, r.unique_spools, r.repeated, r.one_estimator, r.status) for r in report.gates(spark.createDataFrame(rows, NAMES), "report", ["cohort"]).collect()}
    assert got == {
        "fits": (20, 20, 0, True, "pass"), "twice": (25, 24, 1, True, "refused"), "other cohort": (25, 24, 0, True, "pass"), "mixed": (25, 25, 0, False, "refused"), "unnamed": (25, 25, 0, False, "refused"),
        "half named": (25, 25, 0, False, "refused"), "many": (51, 51, 0, True, "refused"), "most": (50, 50, 0, True, "pass"), None: (3, 3, 0, True, "insufficient-corpus"),
    }


def grouped(rows):
    out = defaultdict(list)
    for r in rows:
        if r[0] in ("fits", "other cohort", "most", None):
            out[r[0], r[3]].append(dict(zip(COLUMNS, r, strict=True)))
    return out


def counts_for_savings(r):
    return r["withheld_documents"] == 0 and r["input_tokens"] > 0


def test_cohorts(spark, rows):
    got = {(r.report, r.cohort): r for r in report.cohort_rows(spark.createDataFrame(rows, NAMES), "report", ["cohort"]).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for key, some in want.items():
        r, good = got[key], [x for x in some if counts_for_savings(x)]
        assert (r.runs, r.economic_runs) == (len(some), len(good)) and r.runs == r.economic_runs + r.excluded_withheld + r.excluded_without_input
        assert r.percentiles == ("pass" if len(some) >= 5 else "insufficient-cohort") and r.economic_percentiles == ("pass" if len(good) >= 5 else "insufficient-cohort")
        assert r.recall_loss_rate == sum(x["recall_loss"] for x in some) / len(some) and r.withheld_documents_rate == sum(x["withheld_documents"] for x in some) / sum(x["documents"] for x in some)
        for h, of in (("summary", good), ("cards", good), ("toon", [x for x in good if x["toon_tokens"] is not None])):
            base, other = sum(x["input_tokens"] for x in of), sum(x[f"{h}_tokens"] for x in of)
            assert r[f"{h}_token_savings"] == ((base - other) / base if base else None)


def test_measures(spark, rows):
    got = {(r.report, r.cohort, r.measure): r for r in report.cohort_measures(spark.createDataFrame(rows, NAMES), "report", ["cohort"]).collect()}
    for (name, cohort), some in grouped(rows).items():
        good = [x for x in some if counts_for_savings(x)]
        cases = {m: [x[m] for x in some] for m in ("documents", "run_wall_ms")} | {m: [x[m] for x in good if x[m] is not None] for m in ("toon_tokens", "cards_bytes")}
        cases["toon_token_savings"] = [(x["input_tokens"] - x["toon_tokens"]) / x["input_tokens"] for x in good if x["toon_tokens"] is not None]
        for m, values in cases.items():
            if not good and m not in ("documents", "run_wall_ms"):
                assert (name, cohort, m) not in got
                continue
            r, values = got[name, cohort, m], sorted(values)
            rank = lambda p: values[max(0, -(-len(values) * p // 100) - 1)]  # noqa: B023, E731
            many = len(values) >= ledger.FEW
            assert (r.n, r.low, r.high) == ((len(values), values[0], values[-1]) if values else (0, None, None))
            assert (r.p50, r.p90) == ((rank(50), rank(90)) if many else (None, None)) and r["values"] == (values if values and not many else None)


def test_empty(spark):
    none = spark.createDataFrame([], NAMES)
    assert all(f(none, "report", ["cohort"]).count() == 0 for f in (report.gates, report.cohort_rows, report.cohort_measures))


def test_measures_are_gathered_a_row_a_run(spark):
    """Rows of one measure each were dealt out three times, nineteen for a run."""
    from sedge.plans import checks

    plan = checks.corpus_measures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and plan.count("Generate explode") == 1
