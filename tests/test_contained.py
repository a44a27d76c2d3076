"""Containment against a plain loop, with items of every number of words."""

import random

from sedge.functions import probes
from sedge.operators import rules


def test_contained(spark):
    rng = random.Random(1)
    words = ["a", "bb", "ccc", "dé", "", "ee", "x"]
    items = [(i, " ".join(rng.choice(words) for _ in range(i % 12 + 1))) for i in range(60)] + [(90, ""), (91, None), (92, "a"), (93, "é"), (94, "no such thing anywhere")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(70, None), (71, ""), (72, "zz" + items[11][1] + "zz"), (73, items[23][1]), (73, items[23][1])]
    got = rules.contained(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = sorted({(d, i) for d, t in texts for i, x in items if t is not None and x is not None and x in t})
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_no_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rules.contained(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).count() == 0


def test_keys_travel_only_if_items_may_have_them(spark):
    """Of texts longer than a step, each with words by the thousand, few keys but those of the items are left."""
    rng = random.Random(2)
    long = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(60_000)) for _ in range(3)] + ["", "x" * 5, "é" * 700_000]
    items = [(i, t[a : a + n]) for i, (t, a, n) in enumerate((t, rng.randrange(400_000), rng.choice((1, 2, 3, 7, 9, 30, 90))) for t in long[:3] for _ in range(12))] + [(90, "éé"), (91, "xxxxx")]
    keys = probes.item_keys(spark.createDataFrame(items, "item_id long, text string"), 8)
    texts = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").coalesce(1)
    rows = probes.text_keys(texts, [r._kind for r in keys.select("_kind").distinct().collect()], probes.bitmap(keys)).collect()
    of = {r.item_id: r._k for r in keys.collect()}
    assert len(rows) == len(set(rows)) and {(d, of[i]) for d, t in enumerate(long) for i, x in items if x in t} <= set(map(tuple, rows))
    assert len(rows) < 180_000 / 4
