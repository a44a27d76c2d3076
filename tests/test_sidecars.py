"""Sidecars from artifacts of four kinds, their closed schema and rules, and automata by blocks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sedge.operators import automata, sidecar
from sedge.operators.schema import Field, errors


def body(**more):
    return {"object": "response", "model": "m-1", "status": "completed", "usage": {"input_tokens": 30, "output_tokens": 5, "total_tokens": 35}} | more


def event(name, data, end="\n\n"):
    return (f"event: {name}\n" if name else "") + f"data: {data if isinstance(data, str) else json.dumps(data)}{end}"


def done(**more):
    return event("response.completed", {"type": "response.completed", "response": body(**more)})


STREAMS = {
    "whole": (event("response.created", {"type": "response.created"}) + done(), None), "comments and blank lines": ("\n\n: note\n\n" + done() + ": end\n\n\n", None), "carriage returns": (done().replace("\n", "\r"), None), "both": (done().replace("\n", "\r\n"), None), "data in parts": ("event:response.completed\ndata: {\ndata:   \"type\":\"response.completed\",\ndata: \"response\":" + json.dumps(body()) + "}\n\n", None), "event without a name": (event(None, {"type": "ping"}) + done(), None), "event without a type": (event("x", {}) + done(), None),
    "twice": (done() * 2, "after-completion"), "event after": (done() + event("x", {"type": "x"}), "after-completion"), "failed": (event("response.failed", {"type": "response.failed"}), "not-completed"), "name only": (event("response.completed", {"type": "x"}), "name"), "type only": (event(None, {"type": "response.completed", "response": body()}), "name"), "type that is a list": (event("response.completed", '{"type":[],"response":{}}'), "type"),
    "one line end": (done()[:-1], None), "no end at all": (done()[:-2], "unterminated"), "name without data": ("event: x\n\n" + done(), "no-data"), "name twice": ("event: x\nevent: y\ndata: {}\n\n" + done(), "repeated-name"), "name behind data twice": ("event: x\ndata: {}\nevent: x\n\n" + done(), "repeated-name"), "unknown field": ("id: 3\n" + done(), "field"), "leading blank": (" " + done(), "field"), "separator": (done().replace("\n", "\u2028"), "separator"), "nul": (done() + "\x00", "separator"),
    "no json": (event("x", "{") + done(), "not-json"), "list": (event("x", "[1]") + done(), "not-json"), "key twice": (event("x", '{"a":1,"a":2}') + done(), "not-json"), "nothing": ("", "no-completion"), "comments only": (": x\n\n", "no-completion"), "no terminal": (event("x", {"type": "x"}), "no-completion"),
    "not a response": (done(object="thread"), "not-a-response"), "status": (done(status="incomplete"), "not-completed"), "model": (done(model="a b"), "model"), "no usage": (done(usage=None), "no-usage"), "count in quotes": (done(usage={"input_tokens": "3"}), "count"), "count that is true": (done(usage={"input_tokens": True}), "count"), "null count": (done(usage={"input_tokens": 3, "output_tokens": None}), "count"), "no input": (done(usage={"output_tokens": 3}), "input-known"), "total": (done(usage={"input_tokens": 3, "output_tokens": 4, "total_tokens": 8}), "total-is-sum"),
    "details": (done(usage={"input_tokens": 3, "input_tokens_details": [1]}), "details"), "cached": (done(usage={"input_tokens": 3, "input_tokens_details": {"cached_tokens": 4}}), "cached-within-input"), "written": (done(usage={"input_tokens": 3, "input_tokens_details": {"cache_write_tokens": 4}}), "written-within-input"), "reasoning": (done(usage={"input_tokens": 3, "output_tokens": 1, "output_tokens_details": {"reasoning_tokens": 2}}), "reasoning-within-output"), "total under input": (done(usage={"input_tokens": 3, "total_tokens": 2}), "total-covers-input"),
}


def test_streams_of_one_pure_completion(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, (t, _) in STREAMS.items()] + [("null", None)], "key string, text string")
    want = {k: e for k, (_, e) in STREAMS.items()} | {"null": "separator"}
    for block in (4096, 2):
        monkeypatch.setattr(automata, "BLOCK", block)
        got = {r.key: r for r in sidecar.stream_usage(df).collect()}
        assert {k: r.error for k, r in got.items()} == want
    assert all((r.model, r.input_tokens, r.output_tokens, r.total_tokens, r.cached_input_tokens) == (("m-1", 30, 5, 35, None) if r.error is None else (None,) * 5) for r in got.values())


def test_automata_by_blocks(spark):
    rng = random.Random(4)
    table = [[rng.randrange(5) for _ in range(3)] for _ in range(5)]
    words = {k: [rng.randrange(3) for _ in range(rng.randint(1, 60))] for k in range(30)}
    want = {}
    for k, w in words.items():
        s = 2
        for c in w:
            s = table[s][c]
        want[k] = s
    df = spark.createDataFrame([(k, i, c) for k, w in words.items() for i, c in enumerate(w)], "k int, pos long, c int").repartition(4, "pos")
    for block in (1, 7, 4096):
        assert {r.k: r.state for r in automata.final_states(df, ["k"], "pos", "c", table, start=2, block=block).collect()} == want


def test_other_artifacts(spark):
    line = lambda *v: "\n".join(json.dumps(x) for x in v)
    said = {"type": "item.completed", "item": {"type": "agent_message", "text": "done"}}
    turn = {"type": "turn.completed", "usage": {"input_tokens": 9, "cache_write_tokens": 2}}
    cases = {
        ("responses-json", "bare"): (json.dumps(body()), None), ("responses-json", "event"): (json.dumps({"type": "response.completed", "response": body()}), None), ("responses-json", "null type"): (json.dumps(body(type=None)), None), ("responses-json", "failed"): ('{"type":"response.failed"}', "not-completed"), ("responses-json", "type"): ('{"type":3}', "type"), ("responses-json", "list"): ("[]", "not-json"), ("responses-json", "two"): ("{} {}", "not-json"), ("responses-json", "running"): (json.dumps(body(status="in_progress")), "not-completed"), ("responses-json", "no response"): ('{"type":"response.completed"}', "not-a-response"),
        ("responses-input-count", "good"): ('{"object":"response.input_tokens","input_tokens":4}', None), ("responses-input-count", "more keys"): ('{"object":"response.input_tokens","input_tokens":4,"x":1}', "keys"), ("responses-input-count", "object"): ('{"object":"x","input_tokens":4}', "not-a-count"), ("responses-input-count", "text"): ('{"object":"response.input_tokens","input_tokens":"4"}', "count"), ("responses-input-count", "none"): ("", "not-json"),
        ("codex-jsonl", "good"): (line(said, turn) + "\n\n", None), ("codex-jsonl", "two turns"): (line(said, turn, turn), "turns"), ("codex-jsonl", "no message"): (line(turn), "no-message"), ("codex-jsonl", "error"): (line(said, {"type": "error"}, turn), "failed"), ("codex-jsonl", "no json"): (line(said, turn) + "\nx", "not-json"), ("codex-jsonl", "no usage"): (line(said, {"type": "turn.completed"}), "no-usage"), ("codex-jsonl", "count"): (line(said, {"type": "turn.completed", "usage": {"input_tokens": -1}}), "count"), ("codex-jsonl", "empty"): ("", "turns"),
        ("else", "x"): ("{}", "source"),
    }
    rows = [(f"{s}/{k}", s, bytearray(t.encode())) for (s, k), (t, _) in cases.items()] + [("bad", "responses-json", bytearray(b"\xff")), ("null", "codex-jsonl", None), ("sse", "responses-sse", bytearray(done().encode()))]
    got = {r.key: r for r in sidecar.parsed(spark.createDataFrame(rows, "key string, source string, content binary")).collect()}
    assert {k: r.error for k, r in got.items()} == {f"{s}/{k}": e for (s, k), (_, e) in cases.items()} | {"bad": "bytes", "null": "bytes", "sse": None}
    assert (got["codex-jsonl/good"].input_tokens, got["codex-jsonl/good"].cache_write_tokens, got["responses-input-count/good"].input_tokens, got["sse"].model) == (9, 2, 4, "m-1")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def case_rows():
    """Cases with their ledgers' entries and files: (case_id, source, variant, label), entries, files, what is wrong."""
    request, usage = b'{"model":"m-1","input":"x"}', {"responses-json": json.dumps(body()).encode(), "responses-sse": done().encode(), "responses-input-count": b'{"object":"response.input_tokens","input_tokens":4}', "codex-jsonl": b'{"type":"item.completed","item":{"type":"agent_message","text":"d"}}\n{"type":"turn.completed","usage":{"input_tokens":9}}'}
    cases, entries, files, want = [], [], [], {}

    def add(name, source, variant, label=None, error=None, requests=(request,), used=None, change=None):
        cases.append((name, source, variant, label, "a" * 64, "b" * 64, "c" * 64))
        own = {n: f"{name} {n}".encode() for n in ("manifest.json", "summary.md", "source-cards.jsonl", "source-cards.toon")}
        entries.extend((name, n, len(d), sha(d)) for n, d in own.items() if (change, n) != ("unlisted", "summary.md"))
        for n, d in own.items():
            if (change, n) not in (("missing", "summary.md"), ("missing", "source-cards.toon")):
                files.append((name, "artifact", n, 0, bytearray(d + b"!" if (change, n) == ("changed", "manifest.json") else d)))
        files.extend((name, "request", f"r{i}", i, bytearray(r)) for i, r in enumerate(requests))
        if change != "no usage":
            files.append((name, "usage", "u", 0, bytearray(usage.get(source, b"{}") if used is None else used)))
        want[name] = error

    for i, source in enumerate(sidecar.SOURCES):
        for variant in sidecar.HANDOFFS:
            add(f"{source} {variant}", source, variant, "m-1" if source == "codex-jsonl" or i == 0 else None)
    two = (request, b'{"model":"m-1","input":"y"}')
    add("many", "codex-jsonl", "raw_input", "m-1", requests=two * 128)
    add("too many", "codex-jsonl", "raw_input", "m-1", "requests", requests=two * 128 + two[:1])
    add("two", "responses-json", "raw_input", None, "one-request", requests=two)
    add("none", "responses-json", "raw_input", None, "no-request", requests=())
    add("source", "x", "raw_input", None, "source")
    add("variant", "responses-json", "x", None, "variant")
    for change in ("missing", "unlisted", "changed"):
        add(change, "responses-json", "summary_only", None, f"artifact-{change}", change=change)
    add("missing but not asked for", "responses-json", "raw_input", change="missing")
    add("request", "responses-json", "raw_input", None, "request-json", requests=(b"[1]",))
    add("request model", "responses-json", "raw_input", None, "request-model", requests=(b'{"model":"a b"}',))
    add("no usage", "responses-json", "raw_input", None, "no-usage-artifact", change="no usage")
    add("usage", "responses-sse", "raw_input", None, "usage-field", used=b"id: 3\n\n")
    add("label", "responses-json", "raw_input", "m-2", "model-label")
    add("agent without label", "codex-jsonl", "raw_input", None, "model-label")
    add("agent's other request", "codex-jsonl", "raw_input", "m-1", "model-label", requests=(request, b'{"model":"m-2"}'))
    return cases, entries, files, want


@pytest.fixture(scope="module")
def made(spark):
    cases, entries, files, want = case_rows()
    out = sidecar.built(
        spark.createDataFrame(cases, "case_id string, source string, variant string, model_label string, ledger_sha256 string, corpus_ordered_sha256 string, corpus_diversity_sha256 string"),
        spark.createDataFrame(entries, "case_id string, name string, bytes long, sha256 string"), spark.createDataFrame(files, "case_id string, role string, name string, ordinal int, content binary"),
    )
    return {r.case_id: r for r in out.collect()}, want


def test_built_sidecars(made):
    got, want = made
    assert {k: r.error for k, r in got.items()} == want
    v = json.loads(got["codex-jsonl summary_plus_authoritative_cards"].sidecar)
    request = {"bytes": 27, "sha256": sha(b'{"model":"m-1","input":"x"}')}
    assert v["requests"] == {"ordered": [request], "sequence_sha256": sha(json.dumps([request], separators=(",", ":"), sort_keys=True))}
    assert [x["name"] for x in v["handoff_artifacts"]] == ["summary.md", "source-cards.jsonl"] and v["manifest"]["sha256"] == sha("codex-jsonl summary_plus_authoritative_cards manifest.json")
    assert v["model"] == {"label": "m-1", "provenance": "request_declared"} and v["usage"]["input_tokens"] == 9 and v["usage"]["omitted_fields"] == list(sidecar.FIELDS[1:])


def test_built_sidecars_are_valid_and_changed_ones_are_not(spark, made):
    got, want = made
    whole = {k: r.sidecar for k, r in got.items() if want[k] is None}
    base = json.loads(whole["codex-jsonl summary_only"])
    big = json.loads(whole["many"])
    changes = {
        "missing:$.kind": lambda v: v.pop("kind"), "unknown:$.x": lambda v: v.update(x=1), "unknown:$.requests.ordered[0].name": lambda v: v["requests"]["ordered"][0].update(name="r"), "missing:$.usage.total_tokens": lambda v: v["usage"].pop("total_tokens"), "kind:$.ledger": lambda v: v.update(ledger=[]), "range:$.schema_version": lambda v: v.update(schema_version=2), "kind:$.schema_version": lambda v: v.update(schema_version=True),
        "value:$.claims.cost": lambda v: v["claims"].update(cost="low"), "range:$.claims.requests_made": lambda v: v["claims"].update(requests_made=1), "value:$.manifest.sha256": lambda v: v["manifest"].update(sha256="A" * 64), "range:$.manifest.bytes": lambda v: v["manifest"].update(bytes=-1), "kind:$.usage.input_tokens": lambda v: v["usage"].update(input_tokens=None), "kind:$.usage.output_tokens": lambda v: v["usage"].update(output_tokens="3"), "range:$.usage.output_tokens": lambda v: v["usage"].update(output_tokens=1 << 64),
        "range:$.requests.ordered": lambda v: v["requests"].update(ordered=[]), "value:$.model.label": lambda v: v["model"].update(label="a b"), "value:$.source": lambda v: v.update(source="responses-json\n"), "artifacts-of-variant": lambda v: v.update(variant="raw_input"), "request-sequence": lambda v: v["requests"]["ordered"][0].update(bytes=1), "provenance-of-source": lambda v: v["model"].update(provenance="response_returned"), "omitted-are-null": lambda v: v["usage"].update(omitted_fields=[]),
        "cached-within-input": lambda v: v["usage"].update(cached_input_tokens=10, omitted_fields=[f for f in v["usage"]["omitted_fields"] if f != "cached_input_tokens"]), "count-has-input-only": lambda v: (v.update(source="responses-input-count"), v["usage"].update(output_tokens=1, omitted_fields=[f for f in v["usage"]["omitted_fields"] if f != "output_tokens"])),
    }
    rows, expected = [(k, t) for k, t in whole.items()], dict.fromkeys(whole, [])
    for error, change in changes.items():
        v = json.loads(json.dumps(base))
        change(v)
        rows.append((error, json.dumps(v)))
        expected[error] = [error]
    big["source"], big["model"]["provenance"] = "responses-sse", "response_returned"
    rows += [("one-request", json.dumps(big)), ("not-json", "{"), ("null", None)]
    expected |= {"one-request": ["one-request"], "not-json": ["not-json"], "null": ["not-json"]}
    found = {r.k: r.errors for r in sidecar.validated(spark.createDataFrame(rows, "k string, json string").repartition(4), "k").collect()}
    assert found == expected


def test_schemas_name_every_fault_once(spark):
    fields = [Field("$", "object"), Field("$.a", "array", 1, 3), Field("$.a[]", "object"), Field("$.a[].b", "integer|null", 0, 9), Field("$.c", "string", pattern="x+", required=False)]
    docs = {'{"a":[{"b":1},{"b":null}]}': [], '{"a":[{"b":10},{"d":1},3],"c":"xy"}': ["kind:$.a[2]", "missing:$.a[1].b", "range:$.a[0].b", "unknown:$.a[1].d", "value:$.c"], '{"a":[]}': ["range:$.a"], '{"a":[{"b":1.5}],"a.b":1}': ["kind:$.a[0].b", "unknown:$.a.b"], "[]": ["kind:$"], '{"a":[{"b":1}],"c":null}': ["kind:$.c"]}
    got = {r.json: r.errors for r in errors(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "k int, json string"), fields, "k").join(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "k int, json string"), "k").collect()}
    assert got == docs


def test_artifact_states(spark):
    e = spark.createDataFrame([("r", "a", 1, "x"), ("r", "b", 1, "x"), ("r", "c", 1, "x"), (None, "a", 1, "x")], "run string, name string, bytes long, sha256 string")
    f = spark.createDataFrame([("r", "a", 1, "x"), ("r", "b", 1, "y"), ("r", "d", 1, "x"), (None, "a", 1, "x")], "run string, name string, bytes long, sha256 string")
    assert sorted((str(r.run), r.name, r.state) for r in sidecar.artifact_states(e, f, ["run", "name"]).select("run", F.col("name"), "state").collect()) == [("None", "a", "same"), ("r", "a", "same"), ("r", "b", "changed"), ("r", "c", "missing"), ("r", "d", "surplus")]
