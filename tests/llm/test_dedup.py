"""Line, substring and near-duplicate removal against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sedge.llm import components, line_dedup, simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, keep string, n_lines string, _txt string, m int, _keep int, _id int, __id int, _K_id int, _found int"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    lines = ["  A common LINE of text ", "a common line of text", "short", "ÄÖÜ äöü ß x", "", "\tanother line here\r", "zzzzzzzzzz", "ééééé"]
    passage = " ".join(f"p{i}" for i in range(70))
    out = []
    for i in range(n):
        own = [rng.choice(lines) for _ in range(rng.randint(0, 5))] + [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 90)))]
        if rng.random() < 0.4:
            k = rng.randrange(0, 15)
            own.insert(rng.randrange(len(own)), " ".join(passage.split()[k:k + rng.choice([49, 50, 53, 60])]))
        if rng.random() < 0.2 and out:
            own = [rng.choice(out)[1] or ""]
        out.append((rng.choice([i, i, i, None]) if i % 17 == 5 else i, rng.choice(["", None]) if i % 13 == 7 else "\n".join(own)))
    out += [out[3], out[3], (out[4][0], "other text for the same id\na common line of text"), (10**12, "the " * 3000), (10**12 + 1, "the " * 200)]
    rng.shuffle(out)
    return [(d, t, "k", "clash", "c", 1, 2, 3, 4, 5, 6) for d, t in out]


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("parts", ["1", "4", "31"])
def test_line_dedup(spark, parts):
    rows = corpus()
    first = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), d), d)
    want = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        kept = own if d is None else [x for x in own if len(key(x)) < 10 or first[key(x)] >= d]
        want.append((str(d), len(own), len(own) - len(kept), "\n".join(kept)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = line_dedup.dedup_lines(table(spark, rows))
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == sorted(want)
        assert got.columns == [c for c in table(spark, rows).columns if c != "n_lines"] + ["n_lines", "n_dropped"]
        assert got.select("_keep", "_K_id", "_found").distinct().collect() == [(2, 5, 6)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("large", [1, 2000])
def test_substring_dedup(spark, large):
    rows = corpus(2)
    first = {}
    for d, t, *_ in rows:
        w = WORDS.findall(t or "")
        for i in range(len(w) - 49 if d is not None else 0):
            k = tuple(w[i:i + 50])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t, *_ in rows:
        w = WORDS.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[i:i + 50])] < d:
                keep[i:i + 50] = [False] * 50
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        want.append((str(d), len(w), len(w) - len(kept), " ".join(kept), sha(" ".join(kept))))
    got = substring_dedup.remove_repeats(table(spark, rows), large=large)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text, r.kept_sha256) for r in got.collect()) == sorted(want)
    assert sum(x[2] > 0 for x in want) > 5
    assert got.columns == [*table(spark, rows).columns, "n_words", "n_removed", "kept_sha256"] and got.select("_id", "__id", "_found").distinct().collect() == [(3, 4, 6)]


def splitmix(x, k):
    x = (x + k * 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def fingerprint(text, size, seed=42, k=0):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed) for x in s]
    h = [splitmix(x, k) for x in h] if k else h
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def fingerprints(text, size, tables):
    return tuple(fingerprint(text, size, k=k) for k in range(tables))


def linked(prints, distance, total=64):
    """The smallest place reachable from each place; ``prints`` are tuples, or numbers where there is but one table."""
    prints = [p if isinstance(p, tuple) else (p,) for p in prints]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            bits = [(x ^ y).bit_count() for x, y in zip(prints[i], prints[j], strict=True)]
            if min(bits) <= distance and sum(bits) <= total:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(spark):
    rows = corpus(3)
    for size in (4, 5):
        got = simhash.fingerprints(table(spark, rows), size=size)
        want = sorted((str(d), fingerprint(t, size)) for d, t, *_ in rows)
        assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in got.collect()) == want
    got = simhash.fingerprints(table(spark, rows), size=5, tables=3).collect()
    assert sorted(tuple(x & (1 << 64) - 1 for x in r.fps) for r in got) == sorted(fingerprints(t, 5, 3) for _, t, *_ in rows)


@pytest.mark.parametrize(("distance", "wide_from", "block"), [(4, 10**9, 4096), (4, 0, 4096), (4, 10**9, 3), (7, 10**9, 64), (3, 10**9, 64), (0, 10**9, 64)])
def test_links_join_all_within_the_distance(spark, distance, wide_from, block):
    rng = random.Random(distance + block)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        prints.append(x)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, distance + 2)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([([x],) for x in signed], "fps array<long>")
    root = {r.node: r.root for r in components.components(simhash.links_of(df, distance, wide_from=wide_from, block=block)).collect()}
    groups = {}
    for x, k in zip(signed, linked(prints, distance), strict=True):
        groups.setdefault(k, set()).add(x)
    for members in groups.values():
        assert {root.get(x, x) for x in members} == {min(members)}


@pytest.mark.parametrize(("total", "wide_from", "block"), [(20, 10**9, 4096), (20, 10**9, 5), (9, 10**9, 64), (192, 10**9, 64), (20, 0, 64)])
def test_links_over_several_tables(spark, total, wide_from, block):
    rng = random.Random(total + block)
    distance, flips = (4, 4) if not wide_from else (8, 6)
    rows = []
    for _ in range(20):
        x = [rng.getrandbits(64) for _ in range(3)]
        for _ in range(rng.randint(1, 6)):
            x = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips * 2))) for v in x]
            rows.append(tuple(x))
    signed = np.array(rows, "u8").view("i8")
    df = spark.createDataFrame([(x,) for x in signed.tolist()], "fps array<long>")
    got = simhash.links_of(df, distance, total, 3, wide_from, block)
    root = {r.node: r.root for r in components.components(got).collect()}
    nodes = simhash.nodes_of(signed).tolist()
    groups = {}
    for x, k in zip(nodes, linked(rows, distance, total), strict=True):
        groups.setdefault(k, set()).add(x)
    for members in groups.values():
        assert {root.get(x, x) for x in members} == {min(members)}


def test_a_task_passes_on_a_forest():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(2, 30)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 60))]
        root = {}
        kept = [x for x in links if simhash.joins(root, *x)]

        def classes(some):
            own = list(range(n))  # noqa: B023
            for _ in own:
                for a, b in some:
                    own[a] = own[b] = min(own[a], own[b])
            return own

        assert classes(kept) == classes(links) and len(kept) == n - len(set(classes(links)))


def test_every_vector_lies_within_three_bits_of_an_anchor():
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    who, word, over = simhash._words_near(x, 1)
    home = np.bincount(who[over == 0], minlength=len(x))
    assert (home == 1).all() and (np.bitwise_count((x[who] ^ word).astype("u4")) <= 4).all()
    assert (simhash._syndromes()[word] == 0).all()


def test_near_duplicates(spark):
    rows = corpus(4)
    ids = sorted({d for d, *_ in rows if d is not None})
    prints = [(d, fingerprint(t, 4)) for d, t, *_ in rows]
    group = linked([p for _, p in prints], 4)
    least = {}
    for (d, _), g in zip(prints, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = sorted((str(d), str(least.get(g))) for (d, _), g in zip(prints, group, strict=True))
    got = simhash.near_duplicates(table(spark, rows), size=4)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got.collect()) == want and ids


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (line_dedup.dedup_lines(none), substring_dedup.remove_repeats(none), simhash.near_duplicates(none)):
        assert df.count() == 0


def test_nulls_alone(spark):
    rows = table(spark, [(None, t, *[None] * 9) for t in (None, "a line that repeats", "a line that repeats")])
    assert [r.n_dropped for r in line_dedup.dedup_lines(rows).collect()] == [0, 0, 0]
    assert [r.n_removed for r in substring_dedup.remove_repeats(rows).collect()] == [0, 0, 0]
    assert simhash.near_duplicates(rows).where(F.col("component_id").isNull()).count() == 3
