"""Replies cut to a size against leaving out one entry after another."""

import json
import random
import re

from sedge.operators import replies

LIMIT, PROTECTED, DIGEST = 400, "keep-[0-9]+", "ab" * 32


def compact(x):
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def plain(reply):
    size = lambda x: len(compact(x).encode())
    if size(reply) <= LIMIT:
        return "sent", None, reply
    if reply["kind"] == "halted" and reply["receipt"] is None:
        return "split", None, None
    models = (reply["receipt"] or {}).get("observed_models") or []
    kept, n = list(models), 0
    for i in range(len(models) - 1, -1, -1):
        e = models[i]
        if not isinstance(e, dict) or e.get("unit") == "root" or re.fullmatch(PROTECTED, e.get("model", "")):
            continue
        del kept[i]
        n += 1
        wire = reply | {"receipt": reply["receipt"] | {"observed_models": kept}, "trimmed": {"observed_models_omitted": n, "receipt_sha256": DIGEST}}
        if size(wire) <= LIMIT:
            return "trimmed", n, wire
    return "too-large", None, None


def test_trim(spark):
    rng = random.Random(3)
    made = []
    for _ in range(300):
        models = [rng.choice([{"unit": "root", "model": "m"}, {"unit": "u", "model": f"keep-{rng.randrange(9)}"}, {"unit": "é東", "model": "m" * rng.randrange(30)}, {"model": "x"}, "text"]) for _ in range(rng.randrange(14))]
        reply = {"schema": "s", "kind": rng.choice(["done", "halted"]), "job_id": "job-1", "receipt": rng.choice([{"observed_models": models, "z": 1}, {"observed_models": models}, {"a": "x" * rng.randrange(500)}, None]), "detail": "y" * rng.randrange(120)}
        if rng.random() < 0.2:
            reply["trimmed"] = {"observed_models_omitted": 1, "receipt_sha256": "0"}
        if rng.random() < 0.1:
            reply["detail"] = "z" * 500
        made.append(reply)
    rows = [(i, json.dumps(r, ensure_ascii=False), DIGEST) for i, r in enumerate(made)] + [(1000, None, DIGEST), (1001, "[1]", DIGEST), (1002, "{", None)]
    got = {r.reply_id: r for r in replies.trim(spark.createDataFrame(rows, "reply_id int, reply string, receipt_sha256 string"), LIMIT, PROTECTED).collect()}
    seen = set()
    for i, reply in enumerate(made):
        action, omitted, wire = plain(reply)
        seen.add(action)
        assert (got[i].action, got[i].omitted) == (action, omitted), (reply, got[i])
        if wire is not None:
            assert got[i].wire == compact(wire) and len(got[i].wire.encode()) <= LIMIT
        elif action == "too-large":
            assert {k: json.loads(got[i].wire)[k] for k in ("kind", "reason", "receipt", "job_id")} == {"kind": "failed", "reason": "reply-too-large", "receipt": None, "job_id": "job-1"}
        else:
            assert got[i].wire is None
    assert seen == {"sent", "trimmed", "too-large", "split"}
    assert [got[i].action for i in (1000, 1001, 1002)] == ["invalid"] * 3
