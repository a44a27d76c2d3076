"""Near copies against brute force: exact similarities decide, fingerprints only propose."""

import functools
import random

import pytest

import corpus_pipeline as pipeline
from sedge.llm import near_copies
from tests.llm.test_dedup import WORDS, fingerprints


def shingles(text):
    w = WORDS.findall((text or "").lower())
    return frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1


def times(a, b):
    """The product of two polynomials over GF(2)."""
    out = 0
    while b:
        out ^= a * (b & 1)
        a, b = a << 1, b >> 1
    return out


CODE = [times(m, 0b110001110101) for m in range(1 << 12)]  # all multiples of the generator


def parts(x):
    return x & (1 << 22) - 1, x >> 22 & (1 << 21) - 1, x >> 43


@functools.cache
def home(part):
    return min(CODE, key=lambda c: (c ^ part).bit_count())


def meet(x, y):
    return any((home(a) ^ b).bit_count() <= 5 or (home(b) ^ a).bit_count() <= 5 for a, b in zip(parts(x), parts(y), strict=True))


def bits(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def candidates(a, b):
    return bits(a, b) <= 40 and any((x ^ y).bit_count() <= 16 and meet(x, y) for x, y in zip(a, b, strict=True))


def least_place(n, linked):
    """The smallest place reachable from each place."""
    root, links = list(range(n)), [(i, j) for i in range(n) for j in range(i) if linked(i, j)]
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


def texts(seed=5):
    rng = random.Random(seed)
    out = [None, "", "  \n", "a", "A", "a b c d e f", "x " * 40, "x " * 500, "x " * 60 + " ".join(f"y{i}" for i in range(30)), "x " * 60 + " ".join(f"z{i}" for i in range(30))]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 9)):
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("block", "few"), [(near_copies.BLOCK, near_copies.FEW), (3000, 0)])
def test_near_copies(spark, block, few):
    rows = texts()
    sets, prints = [shingles(t) for t in rows], [fingerprints(t, 5, 3) for t in rows]
    some = range(len(rows))
    pairs = {(i, j) for i in some for j in range(i) if sets[i] and sets[j] and candidates(prints[i], prints[j])}
    group = least_place(len(rows), lambda i, j: (i, j) in pairs)
    root = least_place(len(rows), lambda i, j: sets[i] == sets[j] or group[i] == group[j] and bits(prints[i], prints[j]) <= 40 and sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8)
    refused = sum(jaccard(sets[i], sets[j]) < 0.8 for i, j in pairs)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, block=block, few=few).collect()}
    assert got == dict(enumerate(root)) and refused and len(set(root)) < len(root) - 5


def test_the_stage_keeps_what_only_looks_similar(spark):
    rows = [(1, ""), (2, None), (3, "x " * 60 + " ".join(f"y{i}" for i in range(30))), (4, "x " * 60 + " ".join(f"z{i}" for i in range(30))), (5, "x " * 60 + " ".join(f"z{i}" for i in range(30)) + " z")]
    a, b = shingles(rows[2][1]), shingles(rows[3][1])
    assert candidates(fingerprints(rows[2][1], 5, 3), fingerprints(rows[3][1], 5, 3)) and jaccard(a, b) < 0.1
    short = next(t for i in range(20000) if candidates(fingerprints(t := f"a b c d e{i} f{i}", 5, 3), (0, 0, 0)))
    docs = spark.createDataFrame([*rows, (6, short)], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4, 6]
