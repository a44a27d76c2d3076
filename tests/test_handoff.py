"""Rules of hand-offs: a ledger that keeps them all, and one thing broken at a time."""

import copy

import pytest
from pyspark.sql import functions as F

from sedge.operators import handoff, ledger

SIZE = "struct<bytes: bigint, tokens: bigint>"
SCHEMA = f"""name string, input_bytes bigint, input_tokens bigint, withheld_documents int, minimum double, toon_selected boolean, measured boolean, artifacts map<string, {SIZE}>,
handoffs map<string, struct<bytes: bigint, tokens: bigint, byte_savings: double, token_savings: double>>,
recall struct<recognized: map<string, bigint>, total: bigint, handoffs: map<string, struct<retained: map<string, bigint>, retained_total: bigint, status: string>>>,
decision struct<savings_eligible: array<string>, eligible: array<string>, best: string, recommended: string, gate: string>"""
S, C, T = ledger.HANDOFFS


def good():
    kept = lambda a, b, s: {"retained": {"critical_constraints": a, "open_questions": b}, "retained_total": a + b, "status": s}
    size = lambda b, t, x, y: {"bytes": b, "tokens": t, "byte_savings": x, "token_savings": y}
    return {
        "input_bytes": 640, "input_tokens": 160, "withheld_documents": 0, "minimum": 0.25, "toon_selected": True, "measured": True,
        "artifacts": {"summary": {"bytes": 100, "tokens": 20}, "cards": {"bytes": 300, "tokens": 120}, "toon": {"bytes": 200, "tokens": 60}},
        # 0.84375 and 0.53125 are ties: each goes to the even digit
        "handoffs": {S: size(100, 20, 0.8438, 0.875), C: size(400, 140, 0.375, 0.125), T: size(300, 80, 0.5312, 0.5)},
        "recall": {"recognized": {"critical_constraints": 2, "open_questions": 1}, "total": 3, "handoffs": {S: kept(1, 1, "recall-loss"), C: kept(2, 1, "pass"), T: kept(2, 1, "pass")}},
        "decision": {"savings_eligible": [S, T], "eligible": [T], "best": S, "recommended": T, "gate": "pass"},
    }


def put(value, *path):
    def change(x):
        for p in path[:-1]:
            x = x[p]
        x[path[-1]] = value

    return change


def both(*changes):
    return lambda x: [c(x) for c in changes]


def legacy(x):
    x.update(measured=False, recall=None, decision={"savings_eligible": None, "eligible": [S, T], "best": S, "recommended": S, "gate": "pass"})


def withheld(x):
    x.update(withheld_documents=1, decision={"savings_eligible": [S, T], "eligible": [], "best": None, "recommended": None, "gate": "withheld"})


def without_input(x):
    x.update(input_bytes=0, input_tokens=0, decision={"savings_eligible": [], "eligible": [], "best": S, "recommended": None, "gate": "below-threshold"})
    for h in x["handoffs"].values():
        h.update(byte_savings=None, token_savings=None)


def all_lose(x):
    x["recall"]["handoffs"][T] = copy.deepcopy(x["recall"]["handoffs"][S])
    x["decision"].update(eligible=[], recommended=None, gate="recall-loss")


def nothing_recognized(x):
    x["recall"].update(recognized=dict.fromkeys(handoff.KINDS, 0), total=0)
    for h in x["recall"]["handoffs"].values():
        h.update(retained=dict.fromkeys(handoff.KINDS, 0), retained_total=0, status="not-applicable")
    x["decision"].update(eligible=[S, T], recommended=S)


def no_toon(x):
    x["toon_selected"] = False
    del x["handoffs"][T], x["recall"]["handoffs"][T]
    x["decision"].update(savings_eligible=[S], eligible=[], recommended=None, gate="recall-loss")


CASES = {
    "good": (lambda x: None, []), "legacy": (legacy, []), "withheld": (withheld, []), "without input": (without_input, []), "all lose": (all_lose, []), "nothing recognized": (nothing_recognized, []), "no toon": (no_toon, []),
    "extra hand-off": (put(False, "toon_selected"), ["decision-eligible", "decision-gate-of-counts", "decision-recommended", "decision-savings-eligible", "handoff-names", "recall-handoffs"]),
    "bytes": (put(201, "artifacts", "toon", "bytes"), ["handoff-bytes"]),
    "tokens": (put(61, "artifacts", "toon", "tokens"), ["handoff-tokens"]),
    "byte savings": (put(0.5313, "handoffs", T, "byte_savings"), ["handoff-byte-savings"]), "token savings": (put(None, "handoffs", C, "token_savings"), ["handoff-token-savings"]),
    "old version with recall": (put(False, "measured"), ["recall-of-version"]),
    "another kind": (put({"critical_constraints": 2, "questions": 1}, "recall", "recognized"), ["decision-eligible", "decision-gate-of-counts", "decision-recommended", "recall-recognized", "recall-recognized-total", "recall-retained", "recall-status"]),
    "recognized total": (put(4, "recall", "total"), ["recall-recognized-total"]),
    "retained too many": (both(put(3, "recall", "handoffs", S, "retained", "critical_constraints"), put(4, "recall", "handoffs", S, "retained_total")), ["recall-retained"]),
    "retained total": (put(1, "recall", "handoffs", C, "retained_total"), ["recall-retained-total"]), "status": (put("pass", "recall", "handoffs", S, "status"), ["recall-status"]),
    "minimum": (put(-0.5, "minimum"), ["decision-minimum", "decision-eligible", "decision-savings-eligible"]),
    "unknown gate": (put("maybe", "decision", "gate"), ["decision-gate", "decision-gate-of-counts"]), "withheld without a document": (put("withheld", "decision", "gate"), ["decision-gate-of-counts", "decision-withheld"]),
    "a document without withheld": (put(1, "withheld_documents"), ["decision-best", "decision-eligible", "decision-gate-of-counts", "decision-recommended", "decision-withheld"]),
    "savings eligible": (put([T, S], "decision", "savings_eligible"), ["decision-savings-eligible"]), "eligible": (put([], "decision", "eligible"), ["decision-eligible"]),
    "best": (put(T, "decision", "best"), ["decision-best"]), "recommended": (put(None, "decision", "recommended"), ["decision-recommended"]),
    "legacy with a list": (both(legacy, put([S, T], "decision", "savings_eligible")), ["decision-savings-eligible"]), "legacy that loses": (both(legacy, put("recall-loss", "decision", "gate")), ["decision-gate", "decision-gate-of-counts"]),
}


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for name, (change, _) in CASES.items():
        x = good()
        change(x)
        out.append({"name": name, **x})
    return spark.createDataFrame(out, SCHEMA)


def test_rules(rows):
    got = {r.name: r.errors for r in ledger.violations(rows, handoff.rules()).collect()}
    assert got == {name: sorted(want) for name, (_, want) in CASES.items()}


def test_ties(spark):
    """Of equal sizes the best is the earlier hand-off, and the recommended one the first by name."""
    x = good()
    x["handoffs"] = {n: {"bytes": 4, "tokens": 1, "byte_savings": 0.9, "token_savings": 0.9} for n in (T, C, S)}
    x["recall"]["handoffs"][S] = x["recall"]["handoffs"][C]
    got = spark.createDataFrame([{"name": "x", **x}], SCHEMA).select(handoff.decide().alias("d")).first().d
    assert (got.best, got.recommended, got.eligible, got.gate) == (S, S, [S, C, T], "pass")


def test_empty(rows):
    assert ledger.violations(rows.where(F.lit(False)), handoff.rules()).count() == 0


def test_a_decision_is_worked_out_once(spark):
    """Every rule wrote the whole decision out again; the query over all orders did not end."""
    from sedge.plans import checks

    rows = checks._handoffs(spark, "/root/testdata/sf0.001", broken=True)
    plan = ledger.violations(rows, handoff.rules("want"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 0
