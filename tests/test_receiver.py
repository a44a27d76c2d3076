"""The receiver: each rule by itself, and records of jobs against walking through all messages, in a batch and in a stream."""

import hashlib
import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest

from sedge.operators import receiver
from sedge.plans.jobs import RULES
from sedge.streaming import chunks

SCHEMA = "message_id string, arrival timestamp, sender string, ticket string, body string, bound boolean, isolated boolean, sessions array<struct<job_id: string, name: string, started_by: string>>"
START = datetime(2026, 1, 1)
SESSIONS = [("job-a", "job-job-a", "receiver"), ("job-b", "job-job-b", "receiver"), ("job-c", "job-job-c", "them"), ("job-d", "other", "receiver")]


def request(job="job-a", quick=True, hits=(), goal="Sum up", drop=(), **change):
    envelope = {"schema": RULES.envelope, "job_id": job, "parent_job_id": None, "depth": 0, "root_id": job, "lane": "business", "tags": [], "custody": "ops", "goal": goal, "inputs": [], "allowed_effects": ["read"], "requested_by": "desk@x", "created_at": "2026-01-01T00:00:00Z"}
    cls = "quick" if quick else "careful"
    envelope |= {k[2:]: v for k, v in change.items() if k.startswith("e_")}
    key = hashlib.sha256(f"{envelope['root_id']}\n{envelope['goal']}".encode()).hexdigest()
    resolution = {"schema": RULES.resolution, "root_class": cls, "root_model": RULES.models[cls], "reroute": None, "carve_out_hits": list(hits), "custody": "ops", "source_label": "Private", "child_policy": {"carve_out_tags": list(hits), **RULES.children[cls]}, "policy_rev": "r1", "dedupe_key": key, "resolved_at": "2026-01-01T00:00:00Z"}
    resolution |= {k[2:]: v for k, v in change.items() if k.startswith("r_")}
    body = {"schema": RULES.request, "kind": "dispatch", "envelope": envelope, "resolution": resolution} | {k[2:]: v for k, v in change.items() if k.startswith("b_")}
    return json.dumps({k: v for k, v in body.items() if k not in drop}, ensure_ascii=False)


def halt(job, **change):
    return json.dumps({"schema": RULES.halt, "kind": "halt", "job_id": job, "reason": "stop", "requested_by": "desk@x", "created_at": "2026-01-01T00:00:00Z"} | change)


CASES = [
    ("launch", None, {}), ("launch", None, {"body": RULES.label + "\n" + request()}), ("launch", None, {"sender": "desk:alpha:9:s1"}),
    ("drop", "sender-not-allowed", {"sender": "desk:gamma:9:s1"}), ("drop", "sender-not-allowed", {"sender": "desk:beta:9"}), ("drop", "sender-not-allowed", {"sender": "desk:beta::s2"}), ("drop", "sender-not-allowed", {"sender": "desk:beta:x:s2"}), ("drop", "sender-not-allowed", {"sender": None}), ("drop", "sender-not-allowed", {"sender": "desk:gamma:9:s1", "body": halt("all")}),
    ("drop", "sender-unbound", {"sender": "desk:alpha:9:s1", "bound": False}), ("drop", "sender-unbound", {"sender": "desk:alpha:9:s1", "bound": None}), ("launch", None, {"bound": None}), ("drop", "ticket-not-allowed", {"ticket": "T-2"}), ("drop", "ticket-not-allowed", {"ticket": None}),
    *[("reply", "request-invalid", {"body": b}) for b in (None, "", "[1]", "{", RULES.label, RULES.label + "\n", RULES.label + "\r\n" + request(), RULES.label + "\nRelayed: " + request(), request() + request(), '{"a": NaN}', '{"schema":1,"schema":1}', request(b_more=1), request(b_kind="halt"), request(b_schema="other"), request(drop=["kind"]))],
    ("halt", None, {"body": halt("all"), "jobs": ["job-a", "job-b"]}), ("halt", None, {"body": halt("job-b"), "jobs": ["job-b"]}), ("halt", None, {"body": halt("all"), "sessions": None, "jobs": []}), ("reply", "halt-job-unknown", {"body": halt("job-c")}), ("reply", "halt-job-unknown", {"body": halt("job-d")}), ("reply", "halt-job-unknown", {"body": halt("job-b"), "sessions": []}), ("reply", "request-invalid", {"body": halt("x")}), ("reply", "request-invalid", {"body": halt("all", reason=" ")}), ("reply", "request-invalid", {"body": halt("all", more=1)}), ("reply", "request-invalid", {"body": halt("all", reason="x" * 601)}),
    *[("reply", "envelope-invalid", {"body": request(**c)}) for c in (
        {"b_envelope": None}, {"b_envelope": []}, {"e_depth": "0"}, {"e_depth": 1}, {"e_depth": -1}, {"e_root_id": "job-z"}, {"e_parent_job_id": "job-z"}, {"job": "all"}, {"job": "Job"}, {"job": "job-a\n"}, {"e_lane": "nowhere"}, {"e_tags": ["No"]}, {"e_tags": ["a", "a"]}, {"e_tags": [1]}, {"e_tags": [None]}, {"e_tags": [f"t{i}" for i in range(17)]}, {"e_custody": "secret"},
        {"goal": ""}, {"goal": " \n"}, {"goal": "a\u0000"}, {"goal": "東" * 2001}, {"e_inputs": [{"ref": "a"}]}, {"e_inputs": [{"ref": "a", "sha256": "0" * 63}]}, {"e_inputs": {}}, {"e_allowed_effects": []}, {"e_allowed_effects": ["none", "read"]}, {"e_allowed_effects": ["fly"]}, {"e_budget_envelope": {}}, {"e_budget_envelope": {"tokens": 0}}, {"e_budget_envelope": {"tokens": "1"}}, {"e_requested_by": "X"}, {"e_created_at": "2026-01-01"}, {"e_more": 1})],
    ("launch", None, {"body": request(e_depth=2, e_parent_job_id="job-p", e_root_id="job-r")}), ("launch", None, {"body": request(e_inputs=[{"ref": "a", "sha256": "0" * 64}], e_budget_envelope={"tokens": 1}, e_allowed_effects=["none"])}),
    ("reply", "resolution-missing", {"body": request(drop=["resolution"])}),
    *[("reply", "resolution-invalid", {"body": request(**c)}) for c in ({"b_resolution": None}, {"r_custody": "public"}, {"hits": ["red-team", "adversarial"]}, {"hits": ["other"]}, {"r_dedupe_key": "0" * 64}, {"r_source_label": "é" * 33}, {"r_source_label": ""}, {"r_child_policy": {"carve_out_tags": [], "forbidden": ["bulk"], "rule": "wide"}}, {"r_child_policy": {"carve_out_tags": ["red-team"], "forbidden": ["bulk"], "rule": "narrow-only"}}, {"r_child_policy": {"carve_out_tags": [], "forbidden": [], "rule": "narrow-only"}}, {"r_reroute": "x"}, {"r_root_class": "x"}, {"r_more": 1})],
    ("reply", "custody-health", {"body": request(e_custody="health", r_custody="health")}), ("reply", "custody-not-admitted", {"body": request(e_lane="research")}), ("launch", None, {"body": request(e_custody="public", r_custody="public")}),
    *[("reply", "resolution-disagrees", {"body": request(**c)}) for c in ({"e_tags": ["redteam"]}, {"goal": "Rеd team"}, {"goal": "Ｒｅｄ team"}, {"e_lane": "develop"}, {"quick": False}, {"quick": False, "e_tags": ["redteam"]}, {"hits": ["red-team"]}, {"quick": False, "e_tags": ["redteam"], "hits": ["red-team"], "r_root_model": "model-q"})],
    ("launch", None, {"body": request(quick=False, e_tags=["redteam"], hits=["red-team"], r_child_policy={"carve_out_tags": ["red-team"], "forbidden": ["hammer", "bulk"], "rule": "narrow-only"})}), ("launch", None, {"body": request(quick=False, goal="Rеd team", r_reroute="carve-out-uncertain")}), ("launch", None, {"body": request(goal="Survey → pages")}),
    ("reply", "model-mismatch", {"body": request(r_root_model="model-x")}), ("reply", "login-isolation", {"isolated": False}), ("reply", "login-isolation", {"isolated": None}), ("reply", "request-invalid", {"arrival": None}),
]


def rows_of(cases):
    out = []
    for i, (_, _, c) in enumerate(cases):
        own = {"message_id": f"m{i:03}", "arrival": START + timedelta(days=i * 1000), "sender": "desk:beta:9:s2", "ticket": "T-1", "body": request(), "bound": True, "isolated": True, "sessions": SESSIONS} | c
        out.append(tuple(own[k] for k in ("message_id", "arrival", "sender", "ticket", "body", "bound", "isolated", "sessions")))
    return out


def test_rules(spark):
    """The times lie so far apart that no record holds."""
    got = {r.message_id: r for r in receiver.decisions(spark.createDataFrame(rows_of(CASES), SCHEMA), RULES, timedelta(days=1)).collect()}
    assert len(got) == len(CASES)
    for i, (action, reason, c) in enumerate(CASES):
        r = got[f"m{i:03}"]
        assert (r.action, r.reason, r.jobs) == (action, reason, c.get("jobs")), (i, c)
        assert (r.model is not None) == (action == "launch")
    bare = receiver.decisions(spark.createDataFrame(rows_of(CASES), SCHEMA).limit(0), RULES, timedelta(days=1))
    assert bare.count() == 0 and bare.columns == ["message_id", "arrival", "job_id", "action", "reason", "jobs", "model"]
    unrecorded = receiver.Rules(RULES.policy, RULES.senders, RULES.ticket, {"careful": "model-c", "quick": None}, RULES.children)
    assert receiver.decisions(spark.createDataFrame(rows_of(CASES[:1]), SCHEMA), unrecorded, timedelta(days=1)).first().reason == "model-unrecorded"


def messages(n, seed=1):
    """Messages of few jobs close together, a third of them of one job, many at the same time, some not isolated; some come twice."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(n) for _ in range(n))
    out = [(f"m{i:04}", START + timedelta(hours=t), "desk:beta:9:s2", "T-1", request(job="job-hot" if rng.random() < 0.3 else f"job-{rng.randrange(6)}") if rng.random() < 0.9 else "{", True, rng.random() < 0.6, SESSIONS) for i, t in enumerate(times)]
    return out + [m for m in out if m[4] != "{" and rng.random() < 0.2]


def walked(rows, keep):
    last, seen, out = {}, set(), []
    for m in sorted(rows, key=lambda m: (m[1], m[0])):
        if m[4] == "{":
            out.append((m[0], "reply", "request-invalid"))
            continue
        if m[0] in seen:
            continue
        seen.add(m[0])
        job = json.loads(m[4])["envelope"]["job_id"]
        reason = "job-id-reused" if job in last and m[1] - last[job] <= keep else None if m[6] else "login-isolation"
        if m[6]:
            last[job] = m[1]
        out.append((m[0], "reply" if reason else "launch", reason))
    return sorted(out, key=str)


@pytest.mark.parametrize("hours", [0, 3, 12, 10_000])
def test_records_in_a_batch(spark, hours):
    rows = messages(300, hours)
    got = receiver.decisions(spark.createDataFrame(rows, SCHEMA).repartition(5), RULES, timedelta(hours=hours))
    assert sorted((tuple(r) for r in got.select("message_id", "action", "reason").collect()), key=str) == walked(rows, timedelta(hours=hours))


def test_records_in_a_stream(spark, tmp_path):
    """Four micro-batches in order of time, the third of which repeats rows of the second: the batch's decisions."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, chunks.PROVIDER)
    rows = sorted(set(map(lambda m: m[:7], messages(200, 7))), key=lambda m: (m[1], m[0]))
    keep = timedelta(hours=5)
    parts = [rows[:60], rows[60:120], [m for m in rows[100:120] if m[4] != "{"] + rows[120:160], rows[160:]]
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    q = None
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
        q = receiver.stream_decisions(stream, RULES, keep, "2 hours").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
        names = ("message_id", "arrival", "sender", "ticket", "body", "bound", "isolated")
        for n, part in enumerate(parts):
            (tmp_path / "x").write_text("".join(json.dumps({k: v.isoformat() if k == "arrival" else v for k, v in zip(names, m, strict=True)}) + "\n" for m in part))
            os.utime(tmp_path / "x", (1_000_000 + n, 1_000_000 + n))
            (tmp_path / "x").rename(src / f"{n}.json")
        want = walked(rows, keep)
        read = lambda: sorted((tuple(r) for r in spark.read.schema("message_id string, action string, reason string").parquet(str(out)).collect()), key=str) if out.exists() else []
        until = time.time() + 120
        while time.time() < until and q.isActive and len(read()) < len(want):
            time.sleep(0.5)
        assert q.exception() is None
        assert read() == want
    finally:
        if q is not None:
            q.stop()
        spark.conf.set(name, before)


def test_checks_take_each_value_out_once_and_messages_are_dealt_out(spark):
    """One projection of all checks took the same values out in every branch, and a table of one split was one task."""
    from sedge.plans import jobs

    messages = jobs.receiver_messages(spark, "/root/testdata/sf0.001")
    assert messages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = receiver.checked(messages, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") < 120, plan.count("try_variant_get")
    assert "json_object_keys" not in plan


def test_messages_take_little_disk(spark):
    """All messages and then the ready ones lay in the shared folder as rows, some 45 bytes a message."""
    from sedge.functions.spread import shared_folder
    from sedge.plans import jobs

    at = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)
    before = size()
    found = jobs.received_messages(spark, "/root/testdata/sf0.01")
    assert 0 < size() - before < 20 * found.count()


@pytest.mark.parametrize("hours", [0, 3, 12, 10_000])
def test_hot_jobs_are_cut(spark, monkeypatch, hours):
    """Cells of one message and of several, some of them without a launch."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    rows = messages(300, hours)
    try:
        spark.conf.set(name, "64")
        monkeypatch.setattr(receiver, "DRAWN", 2)
        ready = receiver.kept(receiver.checked(spark.createDataFrame(rows, SCHEMA), RULES)).where("action = 'ready'")
        cells = receiver._cells(ready).collect()
        hot = [x for x in cells if x._job == "job-hot"]
        assert 8 <= len(hot) <= len(cells) <= 128
        for x, y in zip(hot, hot[1:], strict=False):
            assert y._cell == x._cell + 1 and (x._to_at, x._to_id) == (y._from_at, y._from_id)
        assert hot[0]._from_at is None and hot[-1]._to_at is None
        got = receiver.decisions(spark.createDataFrame(rows, SCHEMA).repartition(5), RULES, timedelta(hours=hours))
        assert sorted((tuple(r) for r in got.select("message_id", "action", "reason").collect()), key=str) == walked(rows, timedelta(hours=hours))
    finally:
        spark.conf.set(name, before)


def test_rows_that_wait_for_python_are_narrow(spark):
    """Whole messages and their variants waited, and took more disk than all else where memory ran out."""
    from sedge.plans import jobs

    plan = receiver.checked(jobs.receiver_messages(spark, "/root/testdata/sf0.001"), RULES)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    under = [plan[i + 1] for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert len(under) == 1
    for wide in ("_v", "_text", "body", "sessions", "_s.envelope.goal"):
        assert f"{wide}#" not in under[0], wide


def test_an_object_with_a_key_twice_and_values_that_are_null(spark):
    """What is read of an object at once: keys, nulls and texts that are none."""
    bodies = [request().replace('"depth": 0', '"depth": 0, "depth": 0'), request(e_goal=None), request(e_goal=5), request(e_job_id=None), request(r_root_model=7), request(e_budget_envelope=None), request(e_budget_envelope={"tokens": None}), request(r_child_policy=None), request(r_carve_out_hits=None)]
    rows = [(f"m{i}", START + timedelta(days=9 * i), "desk:beta:9:s2", "T-1", b, True, True, SESSIONS) for i, b in enumerate(bodies)]
    got = {r.message_id: r.reason for r in receiver.decisions(spark.createDataFrame(rows, SCHEMA), RULES, timedelta(days=1)).collect()}
    want = ["request-invalid"] + ["envelope-invalid"] * 3 + ["resolution-invalid"] + ["envelope-invalid"] * 2 + ["resolution-invalid"] * 2
    assert [got[f"m{i}"] for i in range(len(bodies))] == want
