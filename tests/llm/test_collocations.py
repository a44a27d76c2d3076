"""Phrases against plain counting, and the suffix arrays by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sedge.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in kept.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items()):
                rated.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rated)[:top])]
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "straße", "東京", "a.b", "x,y", "é", "to\tbe"] + [f"w{i}" for i in range(30)]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!?", "; ", "\x0b", "\x0c", "\xa0"]
    rows = []
    for i in range(docs):
        w = [rng.choice(words[:12] if rng.random() < 0.6 else words) + rng.choice(ends if rng.random() < 0.3 else ends[:1]) for _ in range(rng.randint(0, 80))]
        rows.append(("".join(w), rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), ("New York City hall " * 3000, "en"), (None, None), *[("copies of this stand here", "fr")] * 40]


@pytest.mark.parametrize(("seed", "least", "shard"), [(0, 30, 8 << 20), (1, 3, 500), (2, 1, 2000)])
def test_against_plain_counting(spark, monkeypatch, seed, least, shard):
    monkeypatch.setattr(C, "SHARD", shard)
    rows = corpus(seed)
    df = spark.createDataFrame([(t, x, 1, "k") for t, x in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = C.collocations(df, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least)


def test_a_full_bitmap_costs_rows_but_no_results(spark, monkeypatch):
    monkeypatch.setattr(C, "FEWEST", 7)
    monkeypatch.setattr(C, "MOST", 7)  # 128 bits for all
    rows = corpus(3)
    assert sorted(map(tuple, C.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5, top=9).collect())) == plain(rows, 5, top=9)


def test_many_languages_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD", 3000)
    rows = [("same words in each of them " * 3, f"l{i % 90}") for i in range(900)]
    got = C.collocations(spark.createDataFrame(rows, "text string, lang string").coalesce(1), least=30)
    assert sorted(map(tuple, got.collect())) == plain(rows, 30)


def test_large_counts_are_exact(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("x", 1, "a", big), ("x", 1, "b", big + 1), ("x", 2, "a b", big - 1)], "lang string, k int, phrase string, n long")
    assert C.scored(counts).first().score == 2_000_000 * (big - 1) // (2 * big + 1)
    longer = spark.createDataFrame([("x", 3, "a b c", big)], "lang string, k int, phrase string, n long")
    assert C.uncovered(C.scored(counts), longer).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for size in (0, 1, 2, 50, 400):
        ids = rng.integers(0, 4, size)
        order = C.suffix_array(ids, 4)
        assert sorted(order.tolist()) == list(range(size))
        heads = [tuple(ids[i:i + 4]) for i in order]
        assert heads == sorted(heads)
        want = Counter(t for k in (1, 2, 3, 4) for i in range(size - k + 1) if 0 not in (t := tuple(ids[i:i + k].tolist())))
        got = {tuple(ids[p:p + n].tolist()): c for n, at, count in C.ngrams(ids, 1, 4) for p, c in zip(at.tolist(), count.tolist(), strict=True)}
        assert got == want


def test_only_blanks_and_tabs_part_words():
    for i in range(128):
        ids, words = C.words_of(f"a{chr(i)}b".encode())
        parts = [words[j] for j in ids]
        if i in C.BREAKS:
            assert parts == [b".", b"a", b".", b"b"], i
        else:
            assert parts == ([b".", b"a", b"b"] if i in (9, 32) else [b".", b"a" + chr(i).lower().encode() + b"b"]), i


def test_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en"), (".,", "en")], "text string, lang string")).collect() == []
