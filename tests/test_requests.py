"""Request bodies against a plain loop."""

import hashlib
import json
import random

from sedge.operators import chatlog, requests


def tier(name):
    if name in chatlog.TIERS:
        return name, chatlog.TIERS[name]
    parts = name.split("__", 2) if name.startswith("mcp__") else []
    source = f"mcp:{parts[1]}" if len(parts) > 1 and parts[1] else ":".join(name.split(":", 2)[:2]) if name.startswith("mcp:") else None
    return (source, chatlog.TIERS[source]) if source in chatlog.TIERS else None


def texts(content, kind):
    if isinstance(content, str):
        return [content]
    return [b["text"] for b in content if isinstance(b, dict) and b.get("type") == kind and isinstance(b.get("text"), str)] if isinstance(content, list) else []


def link(x):
    return hashlib.sha256(x.encode()).hexdigest()[:16]


def by_loop(body, limit):
    calls, void, docs = {}, set(), []
    for m in body["messages"]:
        for b in m["content"] if isinstance(m["content"], list) else []:
            if m["role"] == "assistant" and b.get("type") == "tool_use" and isinstance(b.get("id"), str) and isinstance(b.get("name"), str):
                if b["id"] in calls and calls[b["id"]] != b["name"]:
                    del calls[b["id"]]
                    void.add(b["id"])
                elif b["id"] not in void:
                    calls[b["id"]] = b["name"]
            if m["role"] == "user" and b.get("type") == "tool_result" and isinstance(b.get("tool_use_id"), str):
                if (known := tier(calls.get(b["tool_use_id"], ""))) is not None:
                    docs += [(f"anthropic:{known[0]}:{link(b['tool_use_id'])}:{n}", known[1], t) for n, t in enumerate(texts(b.get("content"), "text"))]
    return docs[:limit]


def test_messages(spark):
    rng = random.Random(2)
    names, ids = ["Bash", "mcp__linear__get", "mcp:github:x", "Unknown", "Read"], ["", "a", "b", "c", 7, "é" * 600]
    content = ["text", [], [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}, {"type": "text", "text": None}], None, 3, ""]
    bodies = []
    for _ in range(40):
        messages = []
        for _ in range(rng.randint(0, 40)):
            k = rng.randrange(len(ids))
            use = {"type": "tool_use", "id": ids[k], "name": names[k % 5] if rng.random() < 0.97 else rng.choice(names)}
            result = {"type": "tool_result", "tool_use_id": rng.choice(ids), "content": rng.choice(content)}
            messages.append({"role": rng.choice(["assistant", "user"]), "content": rng.choice(["plain", [use, result], [use, result], [result, use, {"type": "text", "text": "x"}]])})
        bodies.append({"model": "m", "messages": messages})
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(90, "no json"), (91, "[1]"), (92, None)], "request int, body string")
    got = {}
    for r in requests.messages_documents(df, limit=5).orderBy("request", "ordinal").collect():
        got.setdefault(r.request, []).append((r.source, r.trust_tier, r.body))
    assert got == {i: d for i, b in enumerate(bodies) if (d := by_loop(b, 5))} and sum(map(len, got.values())) > 20


def test_responses(spark):
    call = lambda i, name: {"type": "function_call", "call_id": i, "name": name}
    out = lambda i, o: {"type": "function_call_output", "call_id": i, "output": o}
    body = {"input": [out("a", "early"), call("a", "Bash"), call("b", "Read"), call("b", "Read"), out("b", "void"), out("a", [{"type": "input_text", "text": "x"}, {"type": "text", "text": "no"}, {"type": "input_text", "text": "y"}]), call("", "Bash"), out("", "none"), "text"]}
    got = requests.responses_documents(spark.createDataFrame([(1, json.dumps(body))], "request int, body string")).orderBy("ordinal").collect()
    assert [(r.source, r.trust_tier, r.body) for r in got] == [(f"openai:Bash:{link('a')}:{n}", "untrusted_tool_output", t) for n, t in enumerate(["early", "x", "y"])]
