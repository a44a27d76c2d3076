"""Whole runs, row-set analysis and the hook's outcomes."""

import json

from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import analyze
from sedge.operators import cards as C
from sedge.plans import condense


def test_condense(spark):
    docs = spark.createDataFrame([("b.md", b"must go\nx\n"), ("a.md", b"- one\n"), ("bad", b"\xff"), ("big", b"x" * 200)], "source string, content binary")
    over = spark.createDataFrame([(1, "a.md", "repo")], "position int, path string, trust_tier string")
    run = condense.condense(docs, "r1", overrides=over, max_bytes=100)
    m = run.manifest.first()
    assert (m.documents, m.withheld_documents, m.cards, m.mixed_trust_tiers) == (4, 2, 2, True)
    assert [i.source for i in m.inputs] == ["a.md", "b.md", "bad", "big"]
    text = run.summary.first().summary
    assert "- c1@s1/src-001 L1-1: ` one `" in text and "- Inputs: 4\n" in text and f"- s4 [untrusted] sha256={m.inputs[3].sha256}" in text
    assert {r.source: r.reason for r in run.documents.collect()} == {"a.md": None, "b.md": None, "bad": "redaction-error", "big": "input-cap"}


def test_a_source_may_come_twice(spark):
    docs = spark.createDataFrame([("a", b"must go\n", 2), ("a", b"must stay\n", 1), ("a", b"must go\n", 3)], "source string, content binary, position int")
    text = condense.condense(docs, "r").summary.first().summary
    assert [x.split()[1] for x in text.splitlines() if " L1-1: " in x] == ["c1@s1/src-001", "c2@s2/src-001", "c3@s2/src-001"]


def test_analyze(spark):
    rows = [{"id": i, "language": "py", "license": "MIT", "name": f"n{i}", "version": "1.0.0"} for i in range(6)]
    texts = spark.createDataFrame([("u", json.dumps({"items": rows})), ("r", json.dumps([{"a": 1}, {"b": 2}])), ("x", "no json")], "source string, value string")
    got = {r.source: r for r in analyze.analyze(texts).collect()}
    assert (got["u"].path, got["u"].name, got["u"].rows, got["u"].recommended) == ("$.items", "items", 6, "toon")
    assert got["u"].toon.startswith('items[6]{id,language,license,name,version} delimiter="\\t":\n  0\tpy\tMIT\tn0\t1.0.0\n')
    assert (got["r"].recommended, got["r"].rows) == ("compact-json", 0) and got["x"].toon is None


def test_card_format(spark):
    docs = T.redact(spark.createDataFrame([("s", "must a\nmust b\nmust c")], "source string, text string").withColumns({"trust_tier": F.lit("t"), "run_id": F.lit("r"), "sha256": T.digest("text")}))
    row = analyze.choose_card_format(C.cards(docs.drop("text"), key="source")).first()
    assert row.toon.startswith("cards[3]{card_id,source,") and row.selected and row.toon_tokens < row.primary_tokens


def test_hook(spark):
    long = "must go on\n" + "word " * 900
    calls = spark.createDataFrame([(1, "on", "Bash", long), (2, "off", "Bash", long), (3, "on", "Bash", "short"), (4, "on", "Bash", None), (5, "on", "Bash", long + "kept")], "call_id long, surface string, tool string, text string")
    key = lambda i, **how: calls.where(f"call_id = {i}").select(T.entry_key(T.digest("text"), condense.hook_settings(**how)).alias("entry_key")).first()[0]
    cache = spark.createDataFrame([(key(5), "from the cache"), (key(1, max_cards=3), "of other settings")], "entry_key string, summary string")
    got = {r.call_id: r for r in condense.hook(calls, cache, {"on": True, "off": False}).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "miss", 2: "bypass", 3: "bypass", 4: "withheld", 5: "hit"}
    three = {r.call_id: r.handed_on for r in condense.hook(calls, cache, {"on": True, "off": False}, max_cards=3).collect()}
    assert three[1] == "of other settings" and three[5] != "from the cache"
    assert got[5].handed_on == "from the cache" and "must go on" in got[1].handed_on and got[2].handed_on == long
