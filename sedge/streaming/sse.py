"""Telemetry of streamed model answers.

Server-sent events come as rows (stream_id, pos, data), data being JSON; :mod:`sedge.streaming.chunks` makes them of raw
chunks. In a batch, a stream's rules are running counts over its events, so windows judge them. In a stream, keyed state
folds events as they come, and a stream is reported when its last event is in, or as unavailable when it has been silent
for too long. Both forms hold a field to its JSON type: a number in quotes is no number.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedge.functions.variants import json_variant, kind_at, number_at, object_at, string_at, with_variant

# Refusal categories that are passed on (others count as "other"), what a model's name may be, the fields
# of usage, and the bounds on a line, an event's data and the content blocks of a stream.
REFUSALS = ("cyber", "bio", "frontier_llm", "reasoning_extraction")
MODEL = r"\A[A-Za-z0-9][A-Za-z0-9._:/@-]{0,127}\z"
USAGE = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
MAX_LINE, MAX_EVENT = 256 * 1024, 1024 * 1024
MAX_BLOCKS = 4096
#: Stands for the data of an event that is over its bounds: no JSON, it voids its stream.
OVERSIZE = "(oversize)"


def frames(texts: DataFrame, key: str = "stream_id", text: str = "text", size: Callable[[Column | str], Column] = F.octet_length) -> DataFrame:
    """(key, pos, event, data) of whole SSE texts: an event ends with a blank line, so what follows the last one is not
    an event; comments are passed over; data lines are joined by line breaks. An event with a line or data over the bounds
    comes as OVERSIZE, by which its whole stream is given up, not the event alone. ``size`` measures lines and data."""
    own = texts.select(key, F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+").alias("_f"))
    whole = own.select(key, F.posexplode(F.slice("_f", 1, F.size("_f") - 1)).alias("pos", "_e"))
    after = lambda x, n: x.substr(F.when(x.substr(F.lit(n), F.lit(1)) == " ", n + 1).otherwise(n), F.length(x))
    field = lambda name: F.transform(F.filter("_l", lambda x: x.startswith(f"{name}:")), lambda x: after(x, len(name) + 2))
    own = whole.select(key, "pos", F.split("_e", "\n").alias("_l")).withColumn("_d", F.array_join(field("data"), "\n"))
    over = F.exists("_l", lambda x: size(x) > MAX_LINE) | (size("_d") > MAX_EVENT)
    return own.select(key, "pos", F.when(~over, F.try_element_at(field("event"), F.lit(1))).alias("event"), F.when(over, OVERSIZE).otherwise(F.col("_d")).alias("data")).where("data <> ''")


def _safe(path: str, v: str | Column = "_v") -> Column:
    """A model's name, if it is a sound one."""
    name = string_at(path, v)
    return F.when(name.rlike(MODEL), name)


def _trigger(v: str | Column = "_v", at: str = "$") -> Column:
    """Whether a fallback block's trigger is sound: none, or a refusal without category or with a known one."""
    absent = lambda p: F.coalesce(kind_at(p, v) == "VOID", F.lit(True))
    category = absent(f"{at}.trigger.category") | F.coalesce(string_at(f"{at}.trigger.category", v).isin(*REFUSALS), F.lit(False))
    return absent(f"{at}.trigger") | (F.coalesce(string_at(f"{at}.trigger.type", v) == "refusal", F.lit(False)) & category)


def _sound_fallback(block: str = "$.content_block") -> Column:
    return _safe(f"{block}.from.model").isNotNull() & _safe(f"{block}.to.model").isNotNull() & _trigger(at=block)


def _answered() -> Column:
    """Whether a usage lists an iteration of a fallback model with a sound model and all counts."""
    whole = lambda x: (string_at("$.type", x) == "fallback_message") & _safe("$.model", x).isNotNull() & functools.reduce(lambda a, b: a & b, [number_at(f"$.{f}", x).isNotNull() for f in USAGE])
    each = F.try_variant_get("_v", "$.usage.iterations", "array<variant>")
    return F.coalesce(F.exists(each, lambda x: F.coalesce(whole(x), F.lit(False))), F.lit(False))


def _refusal(at: str) -> Column:
    """The category of a refusal whose details lie below a path, unknown ones as "other"; null if the stop is another."""
    category = F.when(string_at(f"{at}.stop_details.type") == "refusal", string_at(f"{at}.stop_details.category"))
    return F.when(string_at(f"{at}.stop_reason") == "refusal", F.when(category.isin(*REFUSALS), category).otherwise("other"))


def messages_telemetry(events: DataFrame, key: str = "stream_id") -> DataFrame:
    """One row per stream: complete, and for complete ones model, usage, stop_reason and refusal_category.

    A stream must start once, open and close each content block once (at most MAX_BLOCKS), send its deltas into open blocks
    that are no fallback blocks, have one final delta with no block open, then stop; any event out of order, that is no
    JSON object (with repeated keys it is none) or whose fields have other types than they should voids all its telemetry.
    A count of another type is unknown. Errors only count. A fallback block changes the model that answers to its target's
    and counts as a transition; an unsound one voids the telemetry. A fallback served if the final usage lists its
    iteration and the answer is no refusal.
    """
    c, no = F.col, F.lit(False)
    known = ("message_start", "content_block_start", "content_block_delta", "content_block_stop", "message_delta", "message_stop", "error")
    kind, fallback = c("_kind"), c("_fallback")
    of = {
        "message_start": _safe("$.message.model").isNotNull() & object_at("$.message.usage"),
        "content_block_start": string_at("$.content_block.type").isNotNull() & (~fallback | _sound_fallback()),
        "message_delta": string_at("$.delta.stop_reason").isNotNull() & object_at("$.usage"),
    }
    sound = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), no)
    for name, rule in of.items():
        sound = sound & ((kind != name) | rule)
    usage = {f: F.when(kind == "message_start", number_at(f"$.message.usage.{f}")).when(kind == "message_delta", number_at(f"$.usage.{f}")) for f in USAGE}
    # what an event says by itself; its text goes no further
    e = with_variant(events, "data", "_v").withColumns({"_kind": F.coalesce(string_at("$.type"), F.lit("")), "_fallback": F.coalesce(string_at("$.content_block.type") == "fallback", no)})
    e = e.select(
        key, "pos", F.when(kind.isin(*known), kind).otherwise("").alias("kind"), number_at("$.index").alias("block"), sound.alias("sound"), ((kind == "content_block_start") & fallback).alias("fallback"),
        F.when(kind == "message_start", _safe("$.message.model")).when((kind == "content_block_start") & fallback, _safe("$.content_block.to.model")).alias("model"),
        F.when(kind == "message_delta", string_at("$.delta.stop_reason")).alias("stop"), F.when(kind == "message_delta", _refusal("$.delta")).alias("refusal"), ((kind == "message_delta") & _answered()).alias("answered"),
        *[v.alias(f) for f, v in usage.items()],
    )
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda kind, w: F.coalesce(F.sum((c("kind") == kind).cast("int")).over(w), F.lit(0))
    e = e.withColumns({"opened": n("content_block_start", own), "closed": n("content_block_stop", own), "into": F.coalesce(F.max(c("fallback").cast("int")).over(own), F.lit(0)) > 0})
    e = e.withColumns({"started": n("message_start", before), "final": n("message_delta", before), "stopped": n("message_stop", before), "opens": n("content_block_start", before), "closes": n("content_block_stop", before)})
    bad = {
        "message_start": c("started") > 0,
        "content_block_start": (c("started") == 0) | (c("final") > 0) | (c("opens") >= MAX_BLOCKS) | c("block").isNull() | (c("opened") > 0),
        "content_block_delta": c("block").isNull() | (c("opened") == 0) | (c("closed") > 0) | c("into"),
        "content_block_stop": c("block").isNull() | (c("opened") == 0) | (c("closed") > 0),
        "message_delta": (c("started") == 0) | (c("final") > 0) | (c("opens") != c("closes")),
        "message_stop": (c("started") == 0) | (c("final") == 0),
    }
    wrong = ~c("sound") | (c("stopped") > 0)
    for name, rule in bad.items():
        wrong = wrong | ((c("kind") == name) & rule)
    last = lambda f: F.coalesce(F.max(F.when(c("kind") == "message_delta", c(f))), F.max(F.when(c("kind") == "message_start", c(f)))).alias(f)
    out = e.withColumn("wrong", F.coalesce(wrong, no)).groupBy(key).agg(
        F.coalesce(F.bool_or(c("kind") == "message_stop") & ~F.bool_or("wrong"), no).alias("complete"), F.count_if(c("kind") == "error").alias("errors"), F.max_by("model", F.when(c("model").isNotNull(), c("pos"))).alias("model"),
        F.max("stop").alias("stop_reason"), F.max("refusal").alias("refusal_category"), *map(last, USAGE), F.count_if("fallback").alias("fallbacks"), F.bool_or("answered").alias("answered"),
    )
    told = lambda x: F.when(c("complete"), c(x)).alias(x)
    return out.select(key, "complete", "errors", *map(told, ("model", "stop_reason", "refusal_category", *USAGE)), F.when(c("complete"), c("fallbacks")).otherwise(0).alias("fallback_transitions"), (c("complete") & c("answered") & (c("stop_reason") != "refusal")).alias("fallback_served"))


def message_telemetry(bodies: DataFrame, key: str = "stream_id", body: str = "body") -> DataFrame:
    """The same columns for answers that came whole, a JSON body each: a message of the assistant with a sound model, a list
    of content, a usage and a reason to stop. Fallback blocks of the content must all be sound; the last one's target is the
    model that answered. Errors are none. Bodies over MAX_EVENT bytes are given up; a null body is an incomplete answer."""
    no = F.lit(False)
    within = F.when(F.octet_length(body) <= MAX_EVENT, F.col(body))
    own = bodies.withColumn("_v", json_variant(within)).withColumn("_blocks", F.try_variant_get("_v", "$.content", "array<variant>"))
    # each fallback block as a stream would bring it
    blocks = F.filter("_blocks", lambda b: F.coalesce(string_at("$.type", b) == "fallback", no))
    target = lambda b: F.when(_safe("$.from.model", b).isNotNull() & _trigger(b), _safe("$.to.model", b))
    targets = F.transform(blocks, target)
    whole = (string_at("$.type") == "message") & (string_at("$.role") == "assistant") & _safe("$.model").isNotNull() & F.startswith(kind_at("$.content"), F.lit("ARRAY")) & object_at("$.usage") & string_at("$.stop_reason").isNotNull()
    own = own.withColumn("_to", targets)
    own = own.withColumn("complete", F.coalesce(whole & ~F.exists("_to", lambda t: t.isNull()), no))
    told = lambda x, name: F.when(F.col("complete"), x).alias(name)
    counts = [told(number_at(f"$.usage.{f}"), f) for f in USAGE]
    return own.select(
        key, "complete", F.lit(0).cast("long").alias("errors"), told(F.coalesce(F.try_element_at("_to", F.lit(-1)), _safe("$.model")), "model"), told(string_at("$.stop_reason"), "stop_reason"), told(_refusal("$"), "refusal_category"), *counts,
        F.when(F.col("complete"), F.size("_to")).otherwise(0).cast("long").alias("fallback_transitions"), F.coalesce(F.col("complete") & _answered() & (string_at("$.stop_reason") != "refusal"), no).alias("fallback_served"),
    )


def responses_telemetry(events: DataFrame, key: str = "stream_id") -> DataFrame:
    """One row per stream of the other protocol: only the last completion counts, and it alone gives usage, of which counts
    that are no whole numbers are unknown. A stream with an event over the bounds is given up; other data that is no JSON
    is passed over."""
    e = events.withColumn("_v", json_variant("data")).select(key, "pos", string_at("$.type").alias("kind"), "data")
    done = F.max_by("data", F.when(F.col("kind") == "response.completed", F.col("pos")))
    given_up = F.bool_or(F.coalesce(F.col("data") == OVERSIZE, F.lit(False)))
    out = e.groupBy(key).agg(F.when(~given_up, done).alias("_d"), F.count_if(F.col("kind").isin("error", "response.failed", "response.incomplete")).alias("errors"))
    paths = {"input_tokens": "usage.input_tokens", "output_tokens": "usage.output_tokens", "total_tokens": "usage.total_tokens", "cached_input_tokens": "usage.input_tokens_details.cached_tokens", "cache_write_tokens": "usage.input_tokens_details.cache_write_tokens", "reasoning_output_tokens": "usage.output_tokens_details.reasoning_tokens"}
    out = out.withColumn("_v", json_variant("_d"))
    return out.select(key, F.col("_d").isNotNull().alias("complete"), "errors", _safe("$.response.model").alias("model"), *[number_at(f"$.response.{p}").alias(f) for f, p in paths.items()])


REPORT = "stream_id string, complete boolean, errors long, model string, stop_reason string, refusal_category string, " + ", ".join(f"{f} long" for f in USAGE) + ", fallback_transitions long, fallback_served boolean"
STATE = "fold string"


def _model(v: object) -> str | None:
    m = v.get("model") if isinstance(v, dict) else None
    return m if isinstance(m, str) and re.fullmatch(MODEL.replace(r"\z", r"\Z"), m) else None


def _whole_number(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 63


def _counts(usage: dict) -> dict:
    return {f: x for f in USAGE if _whole_number(x := usage.get(f))}


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len(out := dict(pairs)) < len(pairs):
        raise ValueError("a key is repeated")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _target(block: dict) -> str | None:
    """The model that a fallback block goes to, none if the block is unsound."""
    t = block.get("trigger")
    ok = t is None or isinstance(t, dict) and t.get("type") == "refusal" and t.get("category") in (None, *REFUSALS)
    return _model(block.get("to")) if ok and _model(block.get("from")) else None


def _served(usage: dict) -> bool:
    given = usage.get("iterations")
    return isinstance(given, list) and any(isinstance(x, dict) and x.get("type") == "fallback_message" and _model(x) is not None and all(_whole_number(x.get(f)) for f in USAGE) for x in given)


def step(s: dict, data: str) -> dict:
    """One event folded into a stream's state: phase 0 before start, 1 in the message, 2 after the final delta, 3 stopped."""
    try:
        v = json.loads(data, parse_constant=_no_constant, object_pairs_hook=_once)
    except (ValueError, TypeError):
        v = None
    if isinstance(v, dict) and v.get("type") == "error":
        s = s | {"errors": s["errors"] + 1}
    if not isinstance(v, dict) or s["phase"] == 3:
        return s | {"bad": True}
    kind, index = v.get("type"), v.get("index")
    inner = {"message_start": "message", "message_delta": "delta"}.get(kind)
    body = v.get(inner) if inner else None
    usage = (body if kind == "message_start" else v) or {}
    usage = usage.get("usage") if isinstance(usage, dict) else None
    seen = s["blocks"].get(str(index)) if _whole_number(index) else None
    if kind == "message_start":
        ok = s["phase"] == 0 and _model(body) and isinstance(usage, dict)
        return s | ({"phase": 1, "model": _model(body), "usage": _counts(usage)} if ok else {"bad": True})
    if kind == "content_block_start":
        block = v.get("content_block")
        ok = s["phase"] == 1 and _whole_number(index) and seen is None and len(s["blocks"]) < MAX_BLOCKS and isinstance(block, dict) and isinstance(block.get("type"), str)
        if not ok:
            return s | {"bad": True}
        if block["type"] == "fallback":
            if not (target := _target(block)):
                return s | {"bad": True}
            s = s | {"model": target, "fallbacks": s["fallbacks"] + 1}
        return s | {"blocks": s["blocks"] | {str(index): "fallback" if block["type"] == "fallback" else "open"}}
    if kind == "content_block_delta":
        return s if seen == "open" else s | {"bad": True}
    if kind == "content_block_stop":
        return s | ({"blocks": s["blocks"] | {str(index): "closed"}} if seen in ("open", "fallback") else {"bad": True})
    if kind == "message_delta":
        still = {"open", "fallback"} & set(s["blocks"].values())
        ok = s["phase"] == 1 and not still and isinstance(body, dict) and isinstance(body.get("stop_reason"), str) and isinstance(usage, dict)
        if not ok:
            return s | {"bad": True}
        stop, why = body["stop_reason"], body.get("stop_details")
        category = why.get("category") if isinstance(why, dict) and why.get("type") == "refusal" else None
        told = (category if category in REFUSALS else "other") if stop == "refusal" else None
        return s | {"phase": 2, "stop": stop, "refusal": told, "usage": s["usage"] | _counts(usage), "served": _served(usage) and stop != "refusal"}
    if kind == "message_stop":
        return s | ({"phase": 3} if s["phase"] == 2 else {"bad": True})
    return s


EMPTY = {"phase": 0, "bad": False, "errors": 0, "blocks": {}, "usage": {}, "model": None, "stop": None, "refusal": None, "fallbacks": 0, "served": False}
#: What is kept of a stream once it is reported, until it has been silent for long.
CLOSED = {"closed": True}


def report(key: str, s: dict) -> pd.DataFrame:
    ok = s["phase"] == 3 and not s["bad"]
    told = lambda x: [x if ok else None]
    return pd.DataFrame({
        "stream_id": [key], "complete": [ok], "errors": [s["errors"]], "model": told(s["model"]), "stop_reason": told(s["stop"]), "refusal_category": told(s["refusal"]),
        **{f: pd.array(told(s["usage"].get(f)), "Int64") for f in USAGE}, "fallback_transitions": [s["fallbacks"] if ok else 0], "fallback_served": [ok and s["served"]],
    })


def _fold(timeout_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else dict(EMPTY)
        if state.hasTimedOut:
            state.remove()
            if "closed" not in s:
                yield report(key[0], s | {"bad": True})
            return
        if "closed" in s:  # reported already: what comes late changes nothing and opens nothing
            state.setTimeoutDuration(timeout_ms)
            return
        rows = pd.concat(list(batches))
        for data in rows.sort_values("pos")["data"]:
            s = step(s, data)
        if s["phase"] == 3:  # reported as soon as it stops
            yield report(key[0], s)
            s = CLOSED
        state.update((json.dumps(s),))
        state.setTimeoutDuration(timeout_ms)

    return run


def stream_telemetry(events: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """A streaming DataFrame of reports out of one of events (stream_id, pos, data); append mode.

    A stream is reported once: when it stops, as it stands at the end of that micro-batch, or when it has been silent for
    ``timeout_ms``. State is one small document per stream, a mere mark from the report on, and goes after that silence.
    Events of a stream must come in order from one micro-batch to the next; within one they are sorted.
    """
    return events.groupBy("stream_id").applyInPandasWithState(_fold(timeout_ms), REPORT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_log_errors(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Grammar of a run's log (run, pos, event, doc): per document one ``doc``, then its cards, then ``end``, documents
    not interleaved; then one ``summary`` and one ``manifest``, last. (run, errors sorted) for runs that break it."""
    w = Window.partitionBy(run).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    n = lambda e: F.coalesce(F.sum((c("event") == e).cast("int")).over(before), F.lit(0))
    e = log.withColumns({"_open": n("doc") - n("end"), "_sum": n("summary"), "_man": n("manifest"), "_prev": F.lag("doc").over(w)})
    rules = {
        "doc-inside-doc": (c("event") == "doc") & (c("_open") != 0),
        "card-outside-doc": (c("event") == "card") & ((c("_open") != 1) | ~c("doc").eqNullSafe(c("_prev"))),
        "end-outside-doc": (c("event") == "end") & ((c("_open") != 1) | ~c("doc").eqNullSafe(c("_prev"))),
        "summary-early": (c("event") == "summary") & ((c("_open") != 0) | (c("_sum") > 0)),
        "manifest-early": (c("event") == "manifest") & ((c("_sum") != 1) | (c("_man") > 0)),
        "after-manifest": c("_man") > 0,
        "unknown-event": ~c("event").isin("doc", "card", "end", "summary", "manifest"),
    }
    found = e.withColumn("_e", F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()])))
    ends = F.when(F.count_if(c("event") == "manifest") != 1, F.array(F.lit("no-manifest"))).otherwise(F.array().cast("array<string>"))
    out = found.groupBy(run).agg(F.flatten(F.collect_set("_e")).alias("_a"), ends.alias("_b"))
    return out.select(run, F.array_sort(F.array_distinct(F.concat("_a", "_b"))).alias("errors")).where(F.size("errors") > 0)
