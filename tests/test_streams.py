"""Streamed answers: the batch form by windows and the stateful form by events must agree."""

import json
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from sedge.sources import readers, sinks
from sedge.streaming import sse


def good(i=0):
    return [
        {"type": "message_start", "message": {"model": "m", "usage": {"input_tokens": 5 + i}}},
        {"type": "content_block_start", "index": 0, "content_block": {"type": "text"}},
        {"type": "content_block_delta", "index": 0},
        {"type": "ping"},
        {"type": "content_block_stop", "index": 0},
        {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 7}},
        {"type": "message_stop"},
    ]


def variants():
    """Streams that differ from a good one in one thing each."""
    fallback = {"type": "fallback", "from": {"model": "m"}, "to": {"model": "n"}}
    out = {"good": good()}
    for name, change in {
        "no model": lambda e: e[0]["message"].pop("model"), "odd model": lambda e: e[0]["message"].update(model="a b"), "block without type": lambda e: e[1]["content_block"].pop("type"), "block that is no object": lambda e: e[1].update(content_block=3),
        "fallback": lambda e: (e[1].update(content_block=fallback), e.pop(2)), "delta into a fallback": lambda e: e[1].update(content_block=fallback), "unsound fallback": lambda e: (e[1].update(content_block={"type": "fallback"}), e.pop(2)),
        "refusal": lambda e: e[5].update(delta={"stop_reason": "refusal", "stop_details": {"type": "refusal", "category": "bio"}}), "other refusal": lambda e: e[5].update(delta={"stop_reason": "refusal", "stop_details": {"type": "refusal", "category": "new"}}),
        "served": lambda e: (e[1].update(content_block=fallback), e.pop(2), e[4]["usage"].update(iterations=[{"type": "fallback_message", "model": "n", **dict.fromkeys(sse.USAGE, 1)}])),
        "cache": lambda e: e[0]["message"]["usage"].update(cache_read_input_tokens=3, cache_creation_input_tokens=4), "odd usage": lambda e: e[5]["usage"].update(output_tokens=-1), "error": lambda e: e.insert(3, {"type": "error"}), "after the stop": lambda e: e.append({"type": "ping"}),
    }.items():
        change(e := good())
        out[name] = e
    return out


def malformed():
    """Streams whose fields have other types than they should, or whose events are no JSON objects, as raw data."""
    sent = lambda e: [json.dumps(v) for v in e]
    out = {}
    for name, change in {
        "index in quotes": lambda e: [x.update(index="0") for x in e if "index" in x], "index with a fraction": lambda e: [x.update(index=0.0) for x in e if "index" in x], "index that is true": lambda e: e[1].update(index=True), "index below zero": lambda e: e[1].update(index=-1), "index beyond a long": lambda e: [x.update(index=1 << 64) for x in e if "index" in x],
        "start usage that is a number": lambda e: e[0]["message"].update(usage=5), "final usage that is a list": lambda e: e[5].update(usage=[1]), "reason that is a number": lambda e: e[5]["delta"].update(stop_reason=3), "type that is a number": lambda e: e[1]["content_block"].update(type=1), "model that is a number": lambda e: e[0]["message"].update(model=5),
        "delta that is text": lambda e: e[5].update(delta="end_turn"), "message that is text": lambda e: e[0].update(message="m"), "block that is a list": lambda e: e[1].update(content_block=["text"]), "kind that is a number": lambda e: e[3].update(type=7), "details that are text": lambda e: e[5].update(delta={"stop_reason": "refusal", "stop_details": "bio"}), "category that is a number": lambda e: e[5].update(delta={"stop_reason": "refusal", "stop_details": {"type": "refusal", "category": 1}}),
        "count in quotes": lambda e: e[5]["usage"].update(output_tokens="7"), "count with a fraction": lambda e: e[5]["usage"].update(output_tokens=7.0), "count that is true": lambda e: e[5]["usage"].update(output_tokens=True), "count beyond a long": lambda e: e[5]["usage"].update(output_tokens=1 << 63), "count that is null": lambda e: e[5]["usage"].update(output_tokens=None), "largest count": lambda e: e[5]["usage"].update(output_tokens=(1 << 63) - 1),
        "trigger that is text": lambda e: (e[1].update(content_block={"type": "fallback", "from": {"model": "m"}, "to": {"model": "n"}, "trigger": "refusal"}), e.pop(2)), "target that is text": lambda e: (e[1].update(content_block={"type": "fallback", "from": {"model": "m"}, "to": "n"}), e.pop(2)), "iteration in quotes": lambda e: e[5]["usage"].update(iterations=[{"type": "fallback_message", "model": "n", **dict.fromkeys(sse.USAGE, "1")}]), "iterations that are an object": lambda e: e[5]["usage"].update(iterations={"type": "fallback_message"}),
    }.items():
        change(e := good())
        out[name] = sent(e)
    for name, data in {"list": "[1]", "number": "5", "text": '"ping"', "null": "null", "nothing": "", "cut": '{"type":"ping"', "not a number": '{"type":"ping","x":NaN}', "infinity": '{"type":"ping","x":-Infinity}', "key twice": '{"type":"ping","type":"ping"}', "two values": "{} {}"}.items():
        out[f"event: {name}"] = [*sent(good())[:3], data, *sent(good())[4:]]
    return out


def cases():
    rng = random.Random(5)
    out = variants()
    for k in range(60):
        e = good(k)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(e))
            if rng.random() < 0.4:
                e.pop(i)
            elif rng.random() < 0.5:
                e.insert(i, rng.choice(good()))
            else:
                j = rng.randrange(len(e))
                e[i], e[j] = e[j], e[i]
            if not e:
                e = good()
        out[f"c{k}"] = e
    return out


def rows(spark, streams):
    return spark.createDataFrame([(k, i, json.dumps(v)) for k, e in streams.items() for i, v in enumerate(e)], "stream_id string, pos int, data string")


def folded(events):
    s = dict(sse.EMPTY)
    for v in events:
        s = sse.step(s, json.dumps(v))
    return {k: None if v != v else v for k, v in sse.report("k", s).astype(object).iloc[0].to_dict().items()}


def test_batch_agrees_with_the_fold(spark):
    streams = cases()
    got = {r.stream_id: r.asDict() for r in sse.messages_telemetry(rows(spark, streams)).collect()}
    assert len(got) == len(streams)
    for k, e in streams.items():
        assert got[k] | {"stream_id": "k"} == {x: None if y is pd.NA else y for x, y in folded(e).items()}, (k, e)
    complete = {k for k in variants() if got[k]["complete"]}
    assert complete == {"good", "fallback", "refusal", "other refusal", "served", "cache", "odd usage", "error"}
    assert got["fallback"]["model"] == "n" and got["served"]["fallback_served"] and not got["fallback"]["fallback_served"] and got["refusal"]["refusal_category"] == "bio" and got["other refusal"]["refusal_category"] == "other"


def test_types_are_held_alike_by_both_forms(spark):
    streams = malformed()
    df = spark.createDataFrame([(k, i, d) for k, e in streams.items() for i, d in enumerate(e)], "stream_id string, pos int, data string")
    got = {r.stream_id: r.asDict() for r in sse.messages_telemetry(df).collect()}
    for k, e in streams.items():
        s = dict(sse.EMPTY)
        for d in e:
            s = sse.step(s, d)
        want = {x: None if y is pd.NA or y != y else y for x, y in sse.report(k, s).astype(object).iloc[0].to_dict().items()}
        assert got[k] == want, k
    complete = {k for k, r in got.items() if r["complete"]}
    assert complete == {"kind that is a number", "details that are text", "category that is a number", "count in quotes", "count with a fraction", "count that is true", "count beyond a long", "count that is null", "largest count", "iteration in quotes", "iterations that are an object"}
    assert {k: got[k]["output_tokens"] for k in complete if got[k]["output_tokens"]} == {"largest count": (1 << 63) - 1} | dict.fromkeys(complete - {x for x in complete if x.startswith(("count", "largest"))}, 7)
    assert got["details that are text"]["refusal_category"] == got["category that is a number"]["refusal_category"] == "other"
    assert not any(r["fallback_served"] for r in got.values())


def test_answers_that_come_whole(spark):
    def body(change=lambda v: None):
        v = {"type": "message", "role": "assistant", "model": "m", "content": [{"type": "text"}, 3], "usage": {"input_tokens": 5, "output_tokens": "7"}, "stop_reason": "end_turn"}
        change(v)
        return json.dumps(v)

    back = {"type": "fallback", "from": {"model": "m"}, "to": {"model": "n"}}
    iteration = {"type": "fallback_message", "model": "n", **dict.fromkeys(sse.USAGE, 1)}
    bodies = {
        "good": body(), "refused": body(lambda v: v.update(stop_reason="refusal", stop_details={"type": "refusal", "category": "bio"})), "refused otherwise": body(lambda v: v.update(stop_reason="refusal")),
        "fallback": body(lambda v: v.update(content=[back, back | {"to": {"model": "o"}}])), "served": body(lambda v: v.update(content=[back], usage={"iterations": [1, iteration]})), "unsound": body(lambda v: v.update(content=[back, {"type": "fallback"}])), "trigger": body(lambda v: v.update(content=[back | {"trigger": {"type": "refusal", "category": "new"}}])),
        "role": body(lambda v: v.update(role="user")), "type": body(lambda v: v.update(type="completion")), "model": body(lambda v: v.update(model="a b")), "content": body(lambda v: v.update(content="x")), "usage": body(lambda v: v.update(usage=[])), "reason": body(lambda v: v.update(stop_reason=None)), "no json": "{", "list": "[]", "null": None, "long": body(lambda v: v.update(x="y" * sse.MAX_EVENT)),
    }
    out = sse.message_telemetry(spark.createDataFrame(list(bodies.items()), "stream_id string, body string"))
    assert out.dtypes == sse.messages_telemetry(rows(spark, {"a": good()})).dtypes
    got = {r.stream_id: r for r in out.collect()}
    assert {k for k, r in got.items() if r.complete} == {"good", "refused", "refused otherwise", "fallback", "served"}
    assert tuple(got["good"])[1:] == (True, 0, "m", "end_turn", None, 5, None, None, None, 0, False)
    assert (got["refused"].refusal_category, got["refused otherwise"].refusal_category) == ("bio", "other")
    assert (got["fallback"].model, got["fallback"].fallback_transitions, got["fallback"].fallback_served) == ("o", 2, False)
    assert (got["served"].model, got["served"].fallback_transitions, got["served"].fallback_served, got["served"].input_tokens) == ("n", 1, True, None)
    assert tuple(got["unsound"])[1:] == (False, 0, None, None, None, None, None, None, None, 0, False)


def test_too_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sse, "MAX_BLOCKS", 2)
    e = good()
    more = [[{"type": "content_block_start", "index": i, "content_block": {"type": "text"}}, {"type": "content_block_stop", "index": i}] for i in (1, 2)]
    two, three = e[:5] + more[0] + e[5:], e[:5] + more[0] + more[1] + e[5:]
    assert {r.stream_id: r.complete for r in sse.messages_telemetry(rows(spark, {"two": two, "three": three})).collect()} == {"two": True, "three": False}
    assert folded(two)["complete"] and not folded(three)["complete"]


def test_an_oversize_event_gives_up_its_stream(spark, monkeypatch):
    monkeypatch.setattr(sse, "MAX_LINE", 300)
    e = good()
    sent = lambda events: "".join(f"data: {json.dumps(v)}\n\n" for v in events)
    done = {"type": "response.completed", "response": {"usage": {"input_tokens": 3}}}
    big = {"type": "ping", "x": "y" * 400}
    texts = spark.createDataFrame([("m", sent(e)), ("m+", sent([*e[:4], big, *e[4:]])), ("r", sent([done])), ("r+", sent([big, done]))], "stream_id string, text string")
    assert {r.stream_id: r.complete for r in sse.messages_telemetry(sse.frames(texts)).where("stream_id like 'm%'").collect()} == {"m": True, "m+": False}
    assert {r.stream_id: r.input_tokens for r in sse.responses_telemetry(sse.frames(texts)).where("stream_id like 'r%'").collect()} == {"r": 3, "r+": None}


def test_refusal(spark):
    e = good()
    e[5]["delta"] = {"stop_reason": "refusal", "stop_details": {"type": "refusal", "category": "new"}}
    assert sse.messages_telemetry(rows(spark, {"a": e})).first().refusal_category == "other"


def test_stateful_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    e = good()
    for n, part in enumerate((e[:3], e[3:], [{"type": "ping"}])):
        at = src / f"{n}.json"
        at.write_text("".join(json.dumps({"stream_id": s, "pos": i + 3 * n, "data": json.dumps(v)}) + "\n" for s in ("a", "b") for i, v in enumerate(part) if not (s == "b" and n)))
        os.utime(at, (1_000_000 + n, 1_000_000 + n))  # files are read in order of age
    stream = spark.readStream.schema("stream_id string, pos long, data string").option("maxFilesPerTrigger", 1).json(str(src))
    q = sse.stream_telemetry(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:  # with timeouts a query goes on when its input ends, so look for its answer
        until = time.time() + 90
        while time.time() < until and not (out.exists() and spark.read.schema(sse.REPORT).parquet(str(out)).count() and len(q.recentProgress) and sum(p["numInputRows"] for p in q.recentProgress) >= 11):
            time.sleep(1)
    finally:
        q.stop()
    assert [(r.stream_id, r.complete, r.model, r.output_tokens) for r in spark.read.parquet(str(out)).collect()] == [("a", True, "m", 7)]


def test_responses_and_frames(spark):
    done = {"type": "response.completed", "response": {"model": "m", "usage": {"input_tokens": 3, "output_tokens": "4", "total_tokens": 7.5, "input_tokens_details": {"cached_tokens": 1}}}}
    text = "event: x\ndata: {\"type\":\"error\"}\n\n: note\ndata: " + json.dumps(done) + "\r\n\r\ndata: {\"type\":\"response.completed\"}"
    r = sse.responses_telemetry(sse.frames(spark.createDataFrame([("s", text)], "stream_id string, text string"))).first()
    assert (r.complete, r.errors, r.model, r.input_tokens, r.cached_input_tokens, r.output_tokens, r.total_tokens) == (True, 1, "m", 3, 1, None, None)


def test_event_log(spark):
    logs = {"ok": ["doc 1", "card 1", "end 1", "doc 2", "end 2", "summary -", "manifest -"], "cut": ["doc 1", "card 1"], "mixed": ["doc 1", "card 2", "end 1", "summary -", "manifest -", "card 1"]}
    log = spark.createDataFrame([(k, i, *x.split()) for k, v in logs.items() for i, x in enumerate(v)], "run_id string, pos int, event string, doc string")
    assert {r.run_id: r.errors for r in sse.event_log_errors(log).collect()} == {"cut": ["no-manifest"], "mixed": ["after-manifest", "card-outside-doc", "end-outside-doc"]}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"b": 2}\nno\n')
    got = readers.jsonish(spark, str(tmp_path)).orderBy("source", "pos").collect()
    assert [(r.pos, r.value) for r in got] == [(0, '{"a": 1}'), (0, '{"a": 1}'), (1, '{"b": 2}'), (2, None)]
    files = readers.text_files(spark, str(tmp_path))
    assert {r.source[-6:]: r.error for r in readers.strict_artifacts(files).collect()} == {"a.json": None, ".jsonl": "not-strict-json"}
    assert readers.checked_spool(files).count() == 2
    made = spark.createDataFrame([("raw", "cards", "x"), ("raw", "summary", "y")], "raw string, artifact string, body string")
    cache = sinks.cache_entries(made, "raw", F.lit("{}"), b"k")
    spoiled = cache.withColumn("body", F.when(F.col("artifact") == "cards", "z").otherwise(F.col("body")))
    wanted = cache.select("entry_key", "artifact").unionByName(spark.createDataFrame([("e", "cards")], "entry_key string, artifact string"))
    assert sorted((r.artifact, r.state, r.body) for r in sinks.cached(wanted, spoiled, b"k").collect()) == [("cards", "miss", None), ("cards", "quarantined", None), ("summary", "hit", "y")]
    sinks.publish(made, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_fallback_blocks(spark):
    def stream(stop="end_turn", **block):
        e = good()
        e[5] = {"type": "message_delta", "delta": {"stop_reason": stop}, "usage": {"output_tokens": 7, "iterations": [3, {"type": "fallback_message", "model": "m2", **dict.fromkeys(sse.USAGE, 1)}]}}
        e[1]["content_block"] = {"type": "fallback", "from": {"model": "m"}, "to": {"model": "m2"}} | block
        e.pop(2)  # such a block takes no delta
        return e

    streams = {"plain": good(), "back": stream(), "told": stream(trigger={"type": "refusal", "category": "bio"}), "refused": stream("refusal"), "no target": stream(to={}), "trigger": stream(trigger={"type": "refusal", "category": "new"})}
    want = {"plain": (True, "m", 0, False), "back": (True, "m2", 1, True), "told": (True, "m2", 1, True), "refused": (True, "m2", 1, False), "no target": (False, None, 0, False), "trigger": (False, None, 0, False)}
    got = {r.stream_id: (r.complete, r.model, r.fallback_transitions, r.fallback_served) for r in sse.messages_telemetry(rows(spark, streams)).collect()}
    assert got == want
    for k, events in streams.items():
        s = dict(sse.EMPTY)
        for v in events:
            s = sse.step(s, json.dumps(v))
        r = sse.report(k, s).iloc[0]
        assert (r.complete, r.model, r.fallback_transitions, r.fallback_served) == want[k]
