"""Operators on small tables, held against plain loops where a loop says it best."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sedge.functions import spread
from sedge.functions import text as T
from sedge.operators import cards as C
from sedge.operators import chatlog, ledger, recall, render, rules, usage


def made_cards(spark, texts, k=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = T.redact(docs).withColumns({"trust_tier": F.lit("t"), "run_id": F.lit("r"), "sha256": T.digest("text")})
    return docs, C.cards(docs.drop("text"), k)


def test_cards(spark):
    _, cards = made_cards(spark, ["- see\n- see\nmust go\nmust go\n\nTODO\n", "a\n\nb\nc\nd", "", None, "---\n1.\n", "https://x.y here"], 4)
    got = [(r.doc_id, r.card_id, r.line_start, r.line_end, r.claim, r.confidence) for r in cards.orderBy("doc_id", "card_id").collect()]
    assert got == [
        (0, "src-001", 2, 4, "must go", "medium"), (0, "src-002", 3, 5, "must go", "medium"), (0, "src-003", 5, 6, "TODO", "medium"), (0, "src-004", 1, 2, "see", "low"),
        (1, "src-001", 1, 2, "a", "low"), (1, "src-002", 2, 4, "b", "low"), (1, "src-003", 3, 5, "c", "low"), (1, "src-004", 4, 5, "d", "low"),
        (5, "src-001", 1, 1, "https://x.y here", "medium"),
    ]


def test_fallback_takes_lines_before_it_drops_repeats(spark):
    _, cards = made_cards(spark, ["a\na\nb\nc"], 2)
    assert [r.claim for r in cards.collect()] == ["a"]


def test_summary(spark):
    docs, cards = made_cards(spark, ["must go\nwhat ?", "x", "x", ""])
    inputs = docs.withColumns({"source": F.when(F.col("doc_id") < 2, "a").otherwise("b"), "trust_tier": F.when(F.col("doc_id") == 2, "web").otherwise("t")})
    text = render.summary(*render.numbered(cards, inputs)).first().summary
    sha = [r.sha256 for r in docs.orderBy("doc_id").collect()]
    assert text == "\n".join([
        "# Condensation r", "", "- Inputs: 4", "- Claims: 4", "- Format: compact-source-index-v1", render.QUOTED, render.MIXED, "",
        "## Sources", f"- s1 [t] sha256={sha[0]}", f"- s2 [t] sha256={sha[1]}", f"- s3 [web] sha256={sha[2]}", f"- s4 [t] sha256={sha[3]}", "",
        "## Claims", "- c1@s1/src-001 L1-2: ` must go `", "- c2@s1/src-002 L1-2: ` what ? `", "- c3@s2/src-001 L1-1: ` x `", "- c4@s3/src-001 L1-1: ` x `", "",
        "## Critical Constraints", "- c1@s1/src-001 [t]", "", "## Open Questions", "- c2@s1/src-002 [t]", "", "## Findings", "- c3@s2/src-001 [t]", "- c4@s3/src-001 [t]", "",
        "## Reopen", *render.REOPEN, "",
    ])


def test_inputs_of_one_name_and_digest_share_an_alias(spark):
    docs, cards = made_cards(spark, ["x", "must y", "x", "x"])
    inputs = docs.withColumn("source", F.when(F.col("doc_id") == 3, "b").otherwise("a"))
    got = {r.doc_id: (r.source_alias, r.ref) for r in render.numbered(cards, inputs)[0].collect()}
    assert got == {0: ("s1", "c1@s1/src-001"), 1: ("s2", "c2@s2/src-001"), 2: ("s1", "c3@s1/src-001"), 3: ("s4", "c4@s4/src-001")}


def test_a_run_without_cards_has_a_summary(spark):
    docs, cards = made_cards(spark, ["", None])
    text = render.summary(*render.numbered(cards, docs.withColumn("source", F.lit("a")).withColumn("sha256", F.lit("0")))).first().summary
    assert "- Inputs: 2\n- Claims: 0\n" in text and "## Claims\n\n## Critical Constraints\n- Nothing found.\n" in text and render.MIXED not in text


def test_ordinals(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, i % 4) for i in range(500)], "g string, k int, w int").repartition(7)
    got = {(r.g, r.k): (r.ordinal, r.before) for r in spread.ordinals(rows, "g", ["k"], "w").collect()}
    n, so_far, want = {}, {}, {}
    for i in range(500):
        g = "a" if i % 3 else "b"
        n[g] = n.get(g, 0) + 1
        want[g, i] = (n[g], so_far.get(g, 0))
        so_far[g] = so_far.get(g, 0) + i % 4
    assert got == want


def test_spread(spark):
    assert spread.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread.spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9


def test_tree_digest(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i, f"l{i}") for i in range(300)], "g string, k long, line string").repartition(5)
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    got = {r.g: (r.digest, r.n) for r in ledger.tree_digest(rows, ["g"], F.col("line"), F.col("k"), ["k"], fan=10).collect()}
    for g in ("a", None):
        own = [i for i in range(300) if ("a" if i % 3 else None) == g]
        level = {}
        for i in own:
            level.setdefault(i // 10, []).append(f"l{i}")
        level = {k: sha(v) for k, v in level.items()}
        up = {}
        for k, v in sorted(level.items()):
            up.setdefault(k // 10, []).append(v)
        assert got[g] == (sha([sha(v) for _, v in sorted(up.items())]), len(own))


def test_recall_spends_each_slot_once(spark):
    docs, cards = made_cards(spark, ["must a\nmust a\nmust b\nmust c"], 2)
    row = recall.status(recall.spent(recall.recognized(docs), recall.claim_slots(cards))).first()
    assert (row.recognized, row.retained, row.status) == (4, 2, "recall-loss")


def test_authoritative_lines(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["must a", "must b", "x", "todo c", ""]) for _ in range(12)) for _ in range(8)]
    docs, cards = made_cards(spark, texts, 5)
    lines = {}
    for r in recall.recognized(docs).collect():
        lines.setdefault((r.doc_id, r.kind), {})[r.line_number] = r.line_text
    want = set()
    for (doc, kind), own in lines.items():
        taken = set()
        for c in sorted(cards.where(f"doc_id = {doc}").collect(), key=lambda c: c.card_rank):
            near = [(own[n] != c.claim, n) for n in range(c.line_start, c.line_end + 1) if n in own and own[n] in c.evidence.split("\n") and n not in taken]
            if near:
                taken.add(min(near)[1])
        want |= {(doc, kind, n) for n in taken}
    assert {(r.doc_id, r.kind, r.line_number) for r in recall.authoritative(recall.recognized(docs), cards).collect()} == want


def test_withhold(spark):
    docs = spark.createDataFrame([(1, b"ok"), (2, b"\xff"), (3, b"x" * 50)], "doc_id int, content binary")
    got = {r.doc_id: (r.reason, r.text, len(r.sha256)) for r in C.withhold(docs, max_bytes=10).collect()}
    assert got == {1: (None, "ok", 64), 2: ("redaction-error", None, 64), 3: ("input-cap", None, 64)}


def test_tiers(spark):
    docs = spark.createDataFrame([("d/a",), ("d/b",), ("e",)], "source string")
    over = spark.createDataFrame([(1, "d/b", "y"), (2, "d", "w"), (3, "d", "x"), (4, "f/", "v")], "position int, path string, trust_tier string")
    docs = docs.unionByName(spark.createDataFrame([("d/b/c/e",), ("d",), ("dd",), ("d/a",), (None,)], "source string"))
    got = sorted((str(r.source), r.trust_tier) for r in C.with_tier(docs, over, "z").collect())
    assert got == [("None", "z"), ("d", "x"), ("d/a", "x"), ("d/a", "x"), ("d/b", "y"), ("d/b/c/e", "y"), ("dd", "z"), ("e", "z")]
    tools = spark.createDataFrame([("Bash",), ("mcp__linear__get",), ("mcp__x__y",), ("mcp:linear:get",), ("mcp:linear",), ("mcp__linear",), ("mcp____linear",), (None,)], "tool string")
    got = {r.tool: (r.tool_source, r.trust_tier) for r in chatlog.with_tier(tools).collect()}
    service = ("mcp:linear", "semi_trusted_service")
    assert got == {"Bash": ("Bash", "untrusted_tool_output"), "mcp__linear__get": service, "mcp:linear:get": service, "mcp:linear": service, "mcp__linear": service}
    assert {r.tool: r.trust_tier for r in chatlog.with_tier(tools, tiers={"mcp__linear": "t"}, default="d").collect()} == {r.tool: "t" if r.tool == "mcp__linear" else "d" for r in tools.collect()}


def test_correlation(spark):
    calls = spark.createDataFrame([(1, 1, "a", "X"), (1, 2, "b", "X"), (1, 4, "b", "Y"), (1, 7, "c", "Z"), (1, 9, "", "Z")], "request int, pos int, id string, name string")
    results = spark.createDataFrame([(1, 3, "b", "t"), (1, 5, "b", "t"), (1, 6, "c", "t"), (1, 8, "a", "t"), (1, 10, "", "t")], "request int, pos int, id string, text string")
    long = "i" * 2000  # ids are any text here; the other protocol takes 1 to 1,024 bytes
    calls = calls.unionByName(spark.createDataFrame([(1, 11, long, "L"), (1, 12, None, "N"), (1, 13, "d", None)], calls.schema))
    results = results.unionByName(spark.createDataFrame([(1, 14, long, "t"), (1, 15, None, "t"), (1, 16, "d", "t")], results.schema))
    assert sorted((r.pos, r.tool) for r in chatlog.correlate_messages(calls, results).collect()) == [(3, "X"), (8, "X"), (10, "Z"), (14, "L")]
    assert sorted((r.pos, r.tool) for r in chatlog.correlate_responses(calls, results).collect()) == [(6, "Z"), (8, "X")]


@pytest.mark.parametrize(("withheld", "savings", "lost", "want"), [(1, 0.9, 0, "withheld"), (0, 0.25, 0, "pass"), (0, 0.2499999, 0, "below-threshold"), (0, 0.9, 1, "recall-loss"), (0, None, 0, "below-threshold")])
def test_gate(spark, withheld, savings, lost, want):
    row = spark.createDataFrame([(withheld, savings, lost)], "w int, s double, l int")
    assert row.select(ledger.gate(F.col("w"), F.col("s"), F.col("l")).alias("g")).first().g == want


def test_usage(spark):
    rows = spark.createDataFrame([("baseline", "k", "q1", 100, None, None, 10, None, 110), ("candidate", "k", "q2", 40, 50, None, 10, 20, 60)], "variant string, bind string, request string, input_tokens long, cached_input_tokens long, cache_write_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long")
    assert {r.variant: r.errors for r in usage.checked(rows).collect()} == {"baseline": [], "candidate": ["cached-over-input", "reasoning-over-output", "total-mismatch"]}
    got = usage.compare(rows, ["bind"], ["request"]).first()
    assert got.input_tokens_savings == 0.6 and got.cached_input_tokens_savings is None


def test_rules(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["c", "a"])], "x array<string>, y array<string>")
    got = row.select(rules.allowed_in_order(F.col("x"), F.col("y")).alias("o"), rules.stamped(F.col("y"), F.col("x")).alias("s"), rules.root_class(F.col("y"), [("z", "1"), ("a", "2")], "3").alias("c")).first()
    assert (got.o, got.s, got.c) == (["a", "c"], ["c", "a", "b"], "2")
    people = spark.createDataFrame([(1, None, "x"), (2, 1, "x"), (3, 1, "y"), (4, 9, "x")], "id int, parent_id int, lane string")
    kids = rules.inherits(people.where("parent_id is not null"), people.select("id", "lane"), ["lane"])
    assert {r.id: (r.missing_parent, r.differs) for r in kids.collect()} == {2: (False, []), 3: (False, ["lane"]), 4: (True, [])}
    items = spark.createDataFrame([("k", i, x) for i, x in enumerate(["aa", "bb", "cccc", "toolongitem", "d"])], "k string, o int, i string")
    assert [r["items"] for r in rules.pack(items, "k", "i", "o", 7).orderBy("reply").collect()] == [["aa", "bb"], ["cccc"], ["toolongitem"], ["d"]]


def test_bound_claims(spark):
    claims = spark.createDataFrame([("k", "go", "s", 1, 2), ("k", "no", "s", 1, 2), ("k", "x", "s", 1, 2)], "case_id string, claim string, source string, line_start int, line_end int")
    cards = spark.createDataFrame([("k", "must go", "s", 1, 2), ("k", "no", "s", 1, 2), ("k", "no x", "t", 1, 2)], "case_id string, claim string, source string, line_start int, line_end int")
    assert {r.claim: r.bound for r in rules.bound_claims(claims, cards).collect()} == {"go": True, "no": False, "x": False}


def test_toon(spark):
    rows = spark.createDataFrame([(2, "b:"), (1, None)], "id int, name string")
    body = render.toon_rows(rows, ["id"])
    assert body.select(render.toon_text(F.lit("r"), F.col("n"), ["id", "name"], F.col("body")).alias("t")).first().t == 'r[2]{id,name} delimiter="\\t":\n  1\tnull\n  2\t"b:"\n'


def test_cohort_id(spark):
    row = spark.createDataFrame([("y", "x")], "b string, a string")
    assert row.select(ledger.cohort_id("b", "a").alias("i")).first().i == hashlib.sha256(json.dumps({"a": "x", "b": "y"}, separators=(",", ":")).encode()).hexdigest()[:16]
