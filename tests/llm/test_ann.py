"""Inner product search against all pairs."""

import numpy as np
import pytest

from sedge.llm import ann


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def exact(ids, x, j, k=20):
    s = x @ x[j]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[j]][:k]
    return [int(ids[i]) for i in order], s[order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 30)).astype("f4").astype(float)
    x *= rng.uniform(0.5, 2, (3000, 1))
    x = x.astype("f4").astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int").repartition(4)
    got = found(ann.nearest(df))
    assert set(got) == set(range(0, 3000, 20)) and all(len(v) == 20 and [r for r, *_ in v] == list(range(1, 21)) for v in got.values())
    hit = 0
    for q, rows in got.items():
        want, _ = exact(np.arange(3000), x, q)
        hit += len(set(want) & {i for _, i, _ in rows})
        assert np.allclose([s for *_, s in rows], [x[i] @ x[q] for _, i, _ in rows], rtol=1e-12)
    assert hit / (20 * len(got)) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).astype("f4").astype(float).tolist()
    rows = [(i, hot) for i in range(200)] + [(i, (-np.array(hot)).tolist()) for i in range(200, 260)]
    rows += [(300, None), (320, []), (340, [0.0] * 8), (360, [float("nan")] + [1.0] * 7), (380, [None] + [1.0] * 7), (None, hot), (40, hot)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)))
    assert set(got) == set(range(0, 260, 20))
    for q in range(0, 200, 20):
        assert [i for _, i, _ in got[q]] == [i for i in range(22) if i != q][:20]
    assert [i for _, i, _ in got[200]] == list(range(201, 221))


def test_copies_score_the_same_in_64_dimensions(spark):
    """Copies that lie in several blocks come out in the order of their ids, with one score."""
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(40, 64))
    rows = [(int(i), kinds[rng.integers(40)].tolist()) for i in rng.permutation(9000)]
    x = {i: v for i, v in rows}
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)))
    assert len(got) == 450
    for q, hits in list(got.items())[:60]:
        best = max((float((np.array(k) * x[q]).sum()), tuple(k)) for k in kinds.tolist())[1]
        same = sorted(i for i, v in x.items() if tuple(v) == best and i != q)[:20]
        assert [i for _, i, _ in hits] == same and len({s for *_, s in hits}) == 1


def test_lengths_and_repeated_ids(spark):
    """Each length is searched among its own, and an id with several vectors takes one place, at its best score."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3 + 2 * (i % 2)).tolist()) for i in range(0, 160)] + [(7, rng.normal(size=5).tolist()), (9, rng.normal(size=3).tolist())]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)))
    for q in range(0, 160, 20):
        own = np.array(next(v for i, v in rows if i == q))
        best = {}
        for i, v in rows:
            if len(v) == len(own) and i != q:
                best[i] = max(best.get(i, -np.inf), float((np.array(v) * own).sum()))
        want = sorted((-s, i) for i, s in best.items())[:20]
        assert [i for _, i, _ in got[q]] == [i for _, i in want] and np.allclose([s for *_, s in got[q]], [-s for s, _ in want], rtol=1e-12)


def test_several_vectors_of_one_id(spark):
    """A query id with two vectors has one list; an id that holds a third of all rows takes one place of each."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)] + [(0, rng.normal(size=4).tolist()) for _ in range(2)] + [(61, (3 * rng.normal(size=4)).tolist()) for _ in range(30)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)))
    assert set(got) == {0, 20, 40}
    for q, hits in got.items():
        best = {}
        for own in (np.array(v) for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((np.array(v) * own).sum()))
        want = sorted((-s, i) for i, s in best.items())[:20]
        assert [(n, i) for n, i, _ in hits] == [(n + 1, i) for n, (_, i) in enumerate(want)] and np.allclose([s for *_, s in hits], [-s for s, _ in want], rtol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_rows(spark, n):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(n)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert {q: len(v) for q, v in got.items()} == ({20 * i: n - 1 for i in range(n)} if n > 1 else {})


def test_score_aware_codes_keep_more_of_the_parallel_part():
    x = np.random.default_rng(2).normal(size=(2000, 64)).astype("f4")
    books = ann.train(x)
    plain = ann.Codebooks(books.dim, 1.0, books.centres)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(b):
        c = ann.code(x, b)
        back = b.centres[np.arange(32)[None], c].reshape(len(x), 64)
        return np.abs(((x - back) * unit).sum(1)).mean()

    assert along(books) < along(plain)
