"""Exact search against all pairs in whole numbers."""

import math

import numpy as np
import pytest

from sedge.llm import topk


def plain(rows, every=50, k=5, scale=256.0):
    own = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in own if i % every == 0}):
        best = {}
        for _, u in (r for r in own if r[0] == q):
            for i, v in own:
                if i != q and len(u) == len(v):
                    s = min(max(sum(a * b for a, b in zip(u, v, strict=True)), -(1 << 63)), (1 << 63) - 1)
                    best[i] = max(best.get(i, s), s)
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def found(spark, rows, kind="float", parts=3, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int, r int").repartition(parts)
    return sorted(map(tuple, topk.exact_topk(df, **more).collect()))


def test_against_all_pairs(spark):
    x = np.random.default_rng(0).normal(size=(1200, 24)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, every=7, k=12, scale=3.0) == plain(rows, 7, 12, 3.0)


def test_many_small_tiles_and_groups(spark, monkeypatch):
    """Several groups on both sides of the grid, and a tree of three levels."""
    for name, value in (("TILE_BYTES", 1), ("TILES", 1), ("QUERIES", 20), ("CHUNK", 3), ("FAN", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-3, 4, 3).astype(float).tolist()) for i in rng.permutation(700)]
    assert found(spark, rows, parts=2, every=10) == plain(rows, 10)


def test_ties_copies_and_repeated_ids(spark):
    hot = [0.5, -0.25, 1.0]
    rows = [(i, hot) for i in range(300)] + [(i % 90, [float(i % 4), 0.1, -0.2]) for i in range(0, 300, 3)] + [(50, hot)] * 200 + [(0, [9.0, 9.0, 9.0]), (-50, hot)]
    assert found(spark, rows, parts=5) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (50, []), (100, [0.0, 0.0]), (None, [5.0, 5.0]), (6, [1.0]), (150, [2.0]), (7, [-1.0, -2.0]), (200, [1.0, 2.0, 3.0]), (8, [-0.001, 0.001])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(50, [1.0])]) == []


@pytest.mark.parametrize("size", [1e3, 1e6, 1e9, 1e14, 1e17, 1e30])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * size).tolist()) for i in range(60)]
    assert found(spark, rows, kind="double") == plain(rows)


def test_products_take_the_narrowest_exact_type():
    rng = np.random.default_rng(3)
    for most in (90, 2900, 1 << 20, 1 << 25, 1 << 40):
        q, x = (rng.integers(-most, most, (5, 7)).astype(float) for _ in range(2))
        want = [[min(max(sum(int(a) * int(b) for a, b in zip(u, v, strict=True)), topk.LEAST), topk.MOST) for v in x] for u in q]
        assert topk.products(q, x).tolist() == want
