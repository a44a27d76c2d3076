"""Roots and custody of jobs in a forest: the rules row by row, and whole forests against walking up each path."""

import random

import pytest
from pyspark.sql import functions as F

from sedge.operators import forest
from sedge.operators.forest import Lane, Policy

STEMS = [("adversar", "adversarial"), ("red-team", "red-team"), ("redteam", "red-team"), ("deep-iterat", "deep-iteration")]
POLICY = Policy(
    {"research": Lane(False, ["public"]), "business": Lane(False, ["public", "ops"]), "develop": Lane(True, ["public", "ops"])}, STEMS,
    {"public": None, "ops": None, "confidential": "custody-confidential", "health": "custody-health"}, {"public": "public", "hosted-ok": "public", "ops": "ops", "private": "ops", "confidential": "confidential", "client-raw": "confidential", "health": "health"},
)
JOBS = "job_id long, parent_id long, tags array<string>, goal string, lane string"


def test_root_rules(spark):
    cases = [
        ([], None, "Survey pages", "research", [], "quick", None), (["red-team-review"], None, "Check", "research", ["red-team"], "careful", "carve-out"), (["x--red--team"], None, "Check", "research", ["red-team"], "careful", "carve-out"), (["refutation"], None, "Check", "research", [], "quick", None), (["deep-iter"], None, "Check", "research", [], "quick", None),
        ([], None, "Red-team the module", "research", ["red-team"], "careful", "carve-out-inferred"), ([], None, "Ｒｅｄ－ｔｅａｍ it", "research", ["red-team"], "careful", "carve-out-inferred"), ([], None, "Rеd team it", "research", [], "careful", "carve-out-uncertain"), ([], None, "Survey café pages", "research", [], "careful", "carve-out-uncertain"), ([], None, None, "research", [], "careful", "carve-out-uncertain"), ([], None, "Survey → pages", "research", [], "quick", None),
        ([], ["adversarial"], "Sum up", "research", ["adversarial"], "careful", "carve-out-inherited"), (["adversarial"], ["adversarial"], "Red-team it", "research", ["adversarial", "red-team"], "careful", "carve-out-inherited"), (["redteam"], ["adversarial"], "Sum up", "research", ["adversarial", "red-team"], "careful", "carve-out"), (["red-team"], None, "Add a test", "develop", ["red-team"], "careful", None), ([], None, "Rеd team", "develop", [], "careful", None),
        ([], None, "x", "nowhere", None, None, None), (["No"], None, "x", "research", None, None, None), ([None], None, "x", "research", None, None, None), (None, None, "x", "research", None, None, None),
    ]
    rows = []
    for i, (tags, parent, goal, lane, *_) in enumerate(cases):
        rows.append((i, 1000 + i if parent else 999 if i % 2 else None, tags, goal, lane))  # 999 is not there
        if parent:
            rows.append((1000 + i, None, parent, "Plan", "develop"))
    got = {r.job_id: r for r in forest.root_classes(spark.createDataFrame(rows, JOBS), POLICY).collect()}
    for i, (*_, hits, root, reroute) in enumerate(cases):
        assert (got[i].hits, got[i].root_class, got[i].reroute, got[i].error) == (hits, root, reroute, None if root else "envelope-invalid"), cases[i]


def test_custody_rules(spark):
    cases = [
        ("Public", None, None, "research", "public"), ("HOSTED_OK", None, None, "research", "public"), (" \tPrivate\n", None, None, "business", "ops"), ("ops", None, None, "research", "custody-not-admitted"), ("Confidential", None, None, "develop", "custody-confidential"), ("client_raw", None, None, "develop", "custody-confidential"), ("Health", None, None, "develop", "custody-health"), ("medical", None, None, "develop", "custody-label-unknown"), (None, None, None, "develop", "custody-label-unknown"), (" public", None, None, "develop", "custody-label-unknown"),
        ("public", None, "ops", "business", "ops"), ("Private", None, "public", "business", "custody-widens"), ("public", "public", "ops", "business", "ops"), ("public", "ops", "public", "business", "custody-widens"), ("public", "ops", None, "business", "custody-widens"), ("public", None, "ops", "research", "custody-not-admitted"), ("ops", "ops", "ops", "develop", "ops"), ("ops", None, "confidential", "develop", "custody-confidential"), ("public", "ops", "health", "develop", "custody-health"), ("public", None, "secret", "develop", "envelope-invalid"), ("public", None, "public", "nowhere", "envelope-invalid"),
    ]
    rows = []
    for i, (label, parent, claimed, lane, _) in enumerate(cases):
        rows.append((i, 1000 + i if parent else None, label, claimed, lane))
        if parent:
            rows.append((1000 + i, None, parent, parent, "develop"))
    got = {r.job_id: r for r in forest.custody(spark.createDataFrame(rows, "job_id long, parent_id long, label string, claimed string, lane string"), POLICY).collect()}
    for i, (*_, want) in enumerate(cases):
        assert (got[i].custody or got[i].reason) == want and (got[i].custody is None) == (got[i].reason is not None), cases[i]


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_what_is_above(spark, shape):
    rng = random.Random(3)
    n = 300
    parent = {i: {"path": i - 1 if i else None, "star": 0 if i else None, "random": rng.choice([None, 10**6, *range(i)]) if i else None}[shape] for i in range(n)}
    value = {i: sorted({rng.choice("abcdefgh") for _ in range(rng.randint(0, 2))}) for i in range(n)}
    rows = [(i, p, value[i], i * 7 % 11) for i, p in parent.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id long, parent_id long, v array<string>, k int")
    sets = {r.job_id: r.above and set(r.above) for r in forest.above(df, "v", F.array_union).collect()}
    most = {r.job_id: r.above for r in forest.above(df, "k", lambda a, b: F.greatest(a, b)).collect()}
    for i in range(n):
        path, p = [], parent[i]
        while p is not None and p in parent:
            path.append(p)
            p = parent[p]
        assert (sets[i] or set()) == set().union(*(value[p] for p in path)) and most[i] == (max(p * 7 % 11 for p in path) if path else None)


def test_circles_are_refused(spark):
    with pytest.raises(ValueError, match="circle"):
        forest.above(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "job_id long, parent_id long, v int"), "v", lambda a, b: F.greatest(a, b), rounds=6)
    assert forest.root_classes(spark.createDataFrame([], JOBS), POLICY).collect() == []


def test_jobs_below_a_hot_one_and_roots(spark, monkeypatch):
    """Roots and all jobs below one other job were one task's in every join; hot jobs are broadcast and roots leave."""
    monkeypatch.setattr(forest, "HOT", 5)
    rows = [(i, None if i in (0, 50) else 0 if i < 30 else i - 1 if i < 60 else 7 if i < 90 else -i, i) for i in range(100)]
    parent = {i: p for i, p, _ in rows}

    def want(i):
        best = None
        while (i := parent.get(i)) is not None and i in parent:
            best = i if best is None else max(best, i)
        return best

    got = forest.above(spark.createDataFrame(rows, "job_id long, parent_id long, v long"), "v", lambda a, b: F.greatest(a, b))
    assert {r.job_id: r.above for r in got.collect()} == {i: want(i) for i in parent}
    assert "BroadcastHashJoin" in str(forest._met(spark.createDataFrame([(i, 1) for i in range(9)], "job_id long, up long"), spark.createDataFrame([(1, 2)], "_to long, _up long"))._jdf.queryExecution().executedPlan().toString())
