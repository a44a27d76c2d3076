"""What a receiver does with the messages that come in: drop, refuse, halt or launch.

A message is judged by itself first, by projections only; what is left then depends on what was launched before. In a batch
messages are dealt out by job, and a hot job's by time too, so one job's may span partitions; in a stream each job has keyed state that goes
when its record has expired. Both forms give the same decisions.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sedge.functions.spread import kept
from sedge.functions.udfs import nfkc
from sedge.functions.variants import keys_at, kind_at, number_at, string_at, with_listed
from sedge.operators import forest, rules

# Forms of ids, times and digests, bounds, reasons of refusals.
JOB = r"\A(?!all\z)[a-z0-9][a-z0-9-]{2,63}\z"
ASKED_BY = r"\A[a-z][a-z0-9:._@-]{0,127}\z"
TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z\z"
SHA256 = r"\A[0-9a-f]{64}\z"
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"
GOAL_BYTES, LABEL_BYTES, REASON_SIZE, TAGS, INPUTS = 6000, 64, 600, 16, 32
STRANGER, UNBOUND, TICKET = "sender-not-allowed", "sender-unbound", "ticket-not-allowed"
REQUEST, ENVELOPE, MISSING, RESOLUTION, DISAGREES = "request-invalid", "envelope-invalid", "resolution-missing", "resolution-invalid", "resolution-disagrees"
UNRECORDED, MISMATCH, REUSED, LOGIN, NO_JOB = "model-unrecorded", "model-mismatch", "job-id-reused", "login-isolation", "halt-job-unknown"
ENVELOPE_KEYS = ("schema", "job_id", "parent_job_id", "depth", "root_id", "lane", "tags", "custody", "goal", "inputs", "allowed_effects", "requested_by", "created_at")
RESOLUTION_KEYS = ("schema", "root_class", "root_model", "reroute", "carve_out_hits", "custody", "source_label", "child_policy", "policy_rev", "dedupe_key", "resolved_at")
HALT_KEYS = ("schema", "kind", "job_id", "reason", "requested_by", "created_at")
REROUTES = (forest.OWN, forest.INHERITED, forest.INFERRED, forest.UNCERTAIN)

DECISION = "message_id string, at long, job_id string, action string, reason string, jobs array<string>, model string"


@dataclass(frozen=True)
class Rules:
    """``senders``: harness:host:session, and whether it must be bound. ``models``: what each root class runs on, None where
    that was never recorded. ``children``: what a resolution must say of child jobs, by root class, but for the hits that
    it repeats; lists named in ``unordered`` may come in any order. ``started_by``: whose sessions a halt may stop."""

    policy: forest.Policy
    senders: Mapping[str, bool]
    ticket: str
    models: Mapping[str, str | None]
    children: Mapping[str, Mapping[str, object]]
    effects: Sequence[str] = ("none", "read", "write")
    unordered: Sequence[str] = ("forbidden",)
    label: str = "[request]"
    relay: str = "Relayed:"
    request: str = "dispatch.request/v1"
    envelope: str = "dispatch/v1"
    resolution: str = "dispatch.resolution/v1"
    halt: str = "dispatch.halt/v1"
    started_by: str = "receiver"


def _prose(text: Column) -> Column:
    """A text that is not blank and has no control characters but tabs and line feeds: two searches, no pattern over all of it."""
    return text.rlike(r"\S") & ~text.rlike(CONTROL)


def _all(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def _list(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _object(keys: Column, need: Sequence[str], may: Sequence[str] = ()) -> Column:
    """Keys of an object with all of ``need`` and nothing but ``need`` and ``may``; they are null where it is no object."""
    return _all(F.size(F.array_except(_list(need), keys)) == 0, F.size(F.array_except(keys, _list([*need, *may]))) == 0)


def _at(path: str) -> str:
    """A path of the message, which lies in a list."""
    return f"$[0].{path}" if path else "$[0]"


def _is(path: str, pattern: str, v: str | Column = "_v") -> Column:
    return F.coalesce(string_at(path, v).rlike(pattern), F.lit(False))


def _strings(x: str | Column) -> Column:
    """A list of texts, else null."""
    a = F.try_variant_get(x, "$", "array<string>")
    return F.when(kind_at("$", x).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(a, lambda x: x.isNull()), a)


#: What checks read: values of objects, and which of these are texts and lists of texts.
VALUES = {"envelope": (*ENVELOPE_KEYS, "budget_envelope"), "resolution": RESOLUTION_KEYS}
TEXTS = ("schema", "kind", "job_id", *(f"envelope.{k}" for k in ENVELOPE_KEYS if k not in ("depth", "tags", "inputs", "allowed_effects")), *(f"resolution.{k}" for k in RESOLUTION_KEYS if k not in ("carve_out_hits", "child_policy")))
LISTS = ("envelope.tags", "envelope.allowed_effects", "resolution.carve_out_hits", "resolution.child_policy.carve_out_tags")
OBJECTS = ("envelope.budget_envelope", "resolution.child_policy")


def _read(rows: DataFrame) -> DataFrame:
    """``rows`` with what several checks read as columns, each taken out of the variant once: in one projection of all
    checks every branch would take it out again. An object is walked through once, as a map, and not for each of its keys."""
    whole = lambda x, path="$": F.try_variant_get(x, path, "map<string,variant>")
    own = rows.withColumns({f"_m.{o}": whole("_v", _at(o)) for o in VALUES} | {f"_x.{k}": F.try_variant_get("_v", _at(k), "variant") for k in TEXTS if "." not in k} | {"_k.": keys_at(_at(""))})
    own = own.withColumns({f"_x.{o}.{k}": F.try_element_at(_m(o), F.lit(k)) for o, keys in VALUES.items() for k in keys} | {f"_k.{o}": F.map_keys(_m(o)) for o in VALUES})
    own = own.withColumn("_m.resolution.child_policy", whole(_x("resolution.child_policy")))
    own = own.withColumns({f"_x.{o}.{k}": F.try_element_at(_m(o), F.lit(k)) for o, k in [("resolution.child_policy", "carve_out_tags")]})
    own = own.withColumns({f"_s.{p}": string_at("$", _x(p)) for p in TEXTS} | {f"_l.{p}": _strings(_x(p)) for p in LISTS})
    return own.withColumns({f"_k.{p}": keys_at("$", _x(p)) for p in OBJECTS})


def _m(path: str) -> Column:
    return F.col(f"`_m.{path}`")


def _x(path: str) -> Column:
    return F.col(f"`_x.{path}`")


def _s(path: str) -> Column:
    return F.col(f"`_s.{path}`")


def _l(path: str) -> Column:
    return F.col(f"`_l.{path}`")


def _k(path: str) -> Column:
    return F.col(f"`_k.{path}`")


def _unique(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


def _envelope(r: Rules) -> Column:
    depth, tags, effects = number_at("$", _x("envelope.depth")), _l("envelope.tags"), _l("envelope.allowed_effects")
    inputs = F.try_variant_get(_x("envelope.inputs"), "$", "array<variant>")
    sound = lambda x: _object(keys_at("$", x), ("ref", "sha256")) & F.coalesce(_prose(string_at("$.ref", x)), F.lit(False)) & _is("$.sha256", SHA256, x)
    budget = _object(_k("envelope.budget_envelope"), (), ("tokens", "wall_seconds"))
    for k in ("tokens", "wall_seconds"):
        budget = budget & (~F.array_contains(_k("envelope.budget_envelope"), k) | F.coalesce(number_at(f"$.{k}", _x("envelope.budget_envelope")) >= 1, F.lit(False)))
    return _all(
        _object(_k("envelope"), ENVELOPE_KEYS, ("budget_envelope",)), _s("envelope.schema") == r.envelope, _s("envelope.job_id").rlike(JOB), _s("envelope.root_id").rlike(JOB), depth >= 0,
        F.when(depth == 0, (kind_at("$", _x("envelope.parent_job_id")) == "VOID") & (_s("envelope.root_id") == _s("envelope.job_id"))).otherwise(_s("envelope.parent_job_id").rlike(JOB)),
        _s("envelope.lane").isin(*r.policy.lanes), _s("envelope.custody").isin(*r.policy.custody), F.size(tags) <= TAGS, _unique(tags), F.forall(tags, lambda t: t.rlike(forest.TAG)),
        _prose(_s("envelope.goal")), F.octet_length(_s("envelope.goal")) <= GOAL_BYTES, F.size(inputs) <= INPUTS, F.forall(inputs, sound),
        F.size(effects) > 0, _unique(effects), F.size(F.array_except(effects, _list(r.effects))) == 0, ~F.array_contains(effects, "none") | (F.size(effects) == 1),
        ~F.array_contains(_k("envelope"), "budget_envelope") | (budget & (F.size(_k("envelope.budget_envelope")) > 0)), _s("envelope.requested_by").rlike(ASKED_BY), _s("envelope.created_at").rlike(TIME),
    )


def _resolution(r: Rules) -> Column:
    hits, child = _l("resolution.carve_out_hits"), _m("resolution.child_policy")
    agreed = F.lit(False)
    for cls, said in r.children.items():
        same = [_object(_k("resolution.child_policy"), ["carve_out_tags", *said]), _l("resolution.child_policy.carve_out_tags") == hits]
        for k, v in said.items():
            if k in r.unordered:
                same.append(F.array_sort(_strings(F.try_element_at(child, F.lit(k)))) == _list(sorted(v)))
            else:
                same.append(F.to_json(F.try_element_at(child, F.lit(k))) == json.dumps(v, separators=(",", ":"), sort_keys=True))
        agreed = agreed | ((_s("resolution.root_class") == cls) & _all(*same))
    key = F.sha2(F.encode(F.concat(_s("envelope.root_id"), F.lit("\n"), _s("envelope.goal")), "UTF-8"), 256)
    label, reroute = _s("resolution.source_label"), _s("resolution.reroute")
    return _all(
        _object(_k("resolution"), RESOLUTION_KEYS), _s("resolution.schema") == r.resolution, _s("resolution.root_class").isin(r.policy.careful, r.policy.quick), F.length(_s("resolution.root_model")) > 0,
        (kind_at("$", _x("resolution.reroute")) == "VOID") | F.coalesce(reroute.isin(*REROUTES), F.lit(False)), F.array_sort(F.array_distinct(hits)) == hits, F.size(F.array_except(hits, _list(sorted({t for _, t in r.policy.stems})))) == 0,
        _s("resolution.custody") == _s("envelope.custody"), (F.length(label) > 0) & (F.octet_length(label) <= LABEL_BYTES), agreed, F.length(_s("resolution.policy_rev")) > 0, _s("resolution.dedupe_key") == key, _s("resolution.resolved_at").rlike(TIME),
    )


def checked(messages: DataFrame, r: Rules) -> DataFrame:
    """``DECISION`` with ``isolated``: what each message comes to by itself; ``ready`` is one whose job may be launched if its
    id is new and its login isolated.

    ``messages``: message_id, arrival, sender, ticket, body; bound, isolated and sessions (job_id, name, started_by), as they
    were when it came. The first check that fails is the reason. A null is a failed check; a message without an id or a time
    is a malformed request. Nothing is shuffled.
    """
    c = F.col
    part = F.split("sender", ":", -1)
    four = (F.size(part) == 4) & F.forall(part, lambda x: x != "") & F.element_at(part, 3).rlike(r"\A[0-9]+\z")
    bound = F.try_element_at(F.create_map(*[F.lit(x) for kv in r.senders.items() for x in kv]), c("_sender"))
    own = messages.withColumn("_sender", F.when(four, F.concat_ws(":", part[0], part[1], part[3])))
    head = r.label + "\n"
    own = own.withColumn("_text", F.when(F.startswith("body", F.lit(head)), F.substring("body", len(head) + 1, 2**31 - 1)).otherwise(c("body")))
    own = _read(with_listed(own, "_text", "_v"))
    # a goal of ASCII is judged here; others go to Python below, when nothing else of a message has to go along
    goal = F.coalesce(_s("envelope.goal"), F.lit(""))
    own = own.withColumns({"_odd": F.when(F.octet_length(goal) > F.length(goal), goal), "_tags": F.coalesce(_l("envelope.tags"), F.array().cast("array<string>"))})
    own = own.withColumn("_n", F.when(c("_odd").isNull(), rules.plain_tag(goal))).withColumn("_own", forest.tag_hits(c("_tags"), r.policy.stems))
    ours = F.transform(F.filter("sessions", lambda s: _all(s["started_by"] == r.started_by, s["name"] == F.concat(F.lit("job-"), s["job_id"]))), lambda s: s["job_id"])
    own = own.withColumns({"_ours": F.when(_s("schema") == r.halt, F.coalesce(ours, F.array().cast("array<string>"))), "_job": _s("job_id")})

    lane = _s("envelope.lane")
    of = lambda pairs, key: functools.reduce(lambda out, kv: F.when(key == kv[0], kv[1]).otherwise(out), pairs, F.lit(None))
    custody = _s("envelope.custody")
    refused = of([(k, F.lit(v)) for k, v in r.policy.custody.items() if v], custody)
    admitted = of([(k, F.coalesce(custody.isin(*x.custody), F.lit(False))) for k, x in r.policy.lanes.items()], lane)
    slow, fast = r.models.get(r.policy.careful), r.models.get(r.policy.quick)
    no = lambda x: ~F.coalesce(x, F.lit(False))
    halt, dispatch = _s("schema") == r.halt, _s("schema") == r.request
    sound_halt = _all(_object(_k(""), HALT_KEYS), _s("kind") == "halt", (c("_job") == "all") | c("_job").rlike(JOB), _prose(string_at(_at("reason"))), F.length(string_at(_at("reason"))) <= REASON_SIZE, _is(_at("requested_by"), ASKED_BY), _is(_at("created_at"), TIME))
    drop = F.when(c("_sender").isNull() | bound.isNull(), STRANGER).when(bound & no(c("bound")), UNBOUND).when(no(c("ticket") == r.ticket), TICKET)
    first = (
        F.when(c("message_id").isNull() | c("arrival").isNull() | no(~F.startswith("_text", F.lit(r.relay))) | _k("").isNull(), REQUEST)
        .when(F.coalesce(halt, F.lit(False)), F.when(~sound_halt, REQUEST).when(no((c("_job") == "all") | F.array_contains("_ours", c("_job"))), NO_JOB))
        .when(no(dispatch) | no(_s("kind") == "dispatch") | ~_object(_k(""), ("schema", "kind"), ("envelope", "resolution")), REQUEST)
        .when(~_envelope(r), ENVELOPE).when(~F.array_contains(_k(""), "resolution"), MISSING).when(~_resolution(r), RESOLUTION)
        .when(refused.isNotNull(), refused).when(no(admitted), forest.NOT_ADMITTED)
    )
    out = own.select(
        "message_id", F.unix_micros(c("arrival").cast("timestamp")).alias("at"), drop.alias("_drop"), first.alias("_first"), F.coalesce(halt, F.lit(False)).alias("_halt"), "_job", "_ours", _s("envelope.job_id").alias("_id"), F.coalesce("isolated", F.lit(False)).alias("isolated"),
        of([(k, F.lit(x.careful)) for k, x in r.policy.lanes.items()], lane).alias("_slow"), "_own", F.when(c("_odd").isNull(), rules.stems_in(c("_n"), r.policy.stems)).alias("_hits"), "_odd", _s("resolution.root_class").alias("_said"), _l("resolution.carve_out_hits").alias("_told"), _s("resolution.root_model").alias("_model"),
    )
    # rows wait for Python in memory or on disk, as many as its socket takes texts of, so they are narrow by now
    out = out.withColumn("_odd", F.when(c("_first").isNull() & c("_drop").isNull() & ~c("_halt"), c("_odd")))
    out = out.withColumn("_plain", nfkc(c("_odd")))
    out = out.withColumns({"_hits": F.coalesce("_hits", rules.stems_in(rules.plain_tag(c("_plain")), r.policy.stems)), "_unsure": F.coalesce(c("_plain").rlike(r"[\p{L}&&[^\x00-\x7F]]"), F.lit(False))})
    careful = c("_slow") | (F.size("_own") > 0) | (F.size("_hits") > 0) | c("_unsure")
    root, model = F.when(careful, r.policy.careful).otherwise(r.policy.quick), c("_model")
    second = (
        F.when(no(c("_said") == root) | no(c("_told") == F.array_sort(F.array_union("_own", "_hits"))), DISAGREES)
        .when(careful & no(model == F.lit(slow)), DISAGREES).when(~careful, F.when(F.lit(fast).isNull(), UNRECORDED).when(no(model == F.lit(fast)), MISMATCH))
    )
    out = out.withColumn("_reason", F.coalesce("_first", F.when(~c("_halt"), second)))
    action = F.when(c("_drop").isNotNull(), "drop").when(c("_reason").isNotNull(), "reply").when(c("_halt"), "halt").otherwise("ready")
    out = out.withColumn("action", action)
    is_ = lambda a, x: F.when(c("action") == a, x)
    jobs = is_("halt", F.when(c("_job") == "all", c("_ours")).otherwise(F.array("_job")))
    return out.select("message_id", "at", is_("ready", c("_id")).alias("job_id"), "action", F.coalesce("_drop", "_reason").alias("reason"), jobs.alias("jobs"), is_("ready", c("_model")).alias("model"), "isolated")


def _settled(rows: DataFrame, reused: Column) -> DataFrame:
    ready = F.col("action") == "ready"
    reason = F.when(ready, F.when(reused, REUSED).when(~F.col("isolated"), LOGIN)).otherwise(F.col("reason"))
    action = F.when(~ready, F.col("action")).when(reason.isNull(), "launch").otherwise("reply")
    return rows.select("message_id", F.timestamp_micros("at").alias("arrival"), "job_id", action.alias("action"), reason.alias("reason"), "jobs", F.when(ready & reason.isNull(), F.col("model")).alias("model"))


def decisions(messages: DataFrame, r: Rules, keep: timedelta) -> DataFrame:
    """(message_id, arrival, job_id, action, reason, jobs, model): what becomes of each message, in order of arrival.

    A job's record holds for ``keep`` after the last message that would have launched it; while it holds, a further message
    with its id is refused. Arrivals that are the same are told apart by message id. A ready message that comes again with
    the same id at the same time counts once; others give a row each. A table without rows has no decisions.
    """
    own = kept(checked(messages, r))
    ready = own.where("action = 'ready'").select("message_id", "at", "job_id", "model", "isolated")
    cells = F.broadcast(_cells(ready))
    c = F.col
    after = c("_from_at").isNull() | (c("at") > c("_from_at")) | ((c("at") == c("_from_at")) & (c("message_id") >= c("_from_id")))
    before = c("_to_at").isNull() | (c("at") < c("_to_at")) | ((c("at") == c("_to_at")) & (c("message_id") < c("_to_id")))
    inside = (c("job_id") == c("_job")) & after & before
    dealt = ready.join(cells, inside, "left").select(*ready.columns, F.coalesce("_cell", F.lit(0)).alias("_p"))
    w = Window.partitionBy("job_id", "_p").orderBy("at", "message_id", "isolated", "model")
    here = F.max(F.when(c("isolated"), c("at"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    once = F.struct(F.lag("at").over(w).alias("at"), F.lag("message_id").over(w).alias("message_id"))
    ranked = dealt.withColumns({"_here": here, "_again": once == F.struct("at", "message_id")})
    # one row a cell: when its job was last launched in the cells before
    ends = ready.where("isolated").join(cells, inside).groupBy("_job", "_cell").agg(F.max("at").alias("_last"))
    earlier = Window.partitionBy("_job").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.select("_job", "_cell").join(F.broadcast(ends), ["_job", "_cell"], "left")
    base = places.select(c("_job").alias("job_id"), c("_cell").alias("_p"), F.max("_last").over(earlier).alias("_base"))
    both = ranked.join(F.broadcast(base), ["job_id", "_p"], "left").where("not coalesce(_again, false)")
    last = F.coalesce("_here", "_base")
    both = both.withColumns({"action": F.lit("ready"), "reason": F.lit(None).cast("string"), "jobs": F.lit(None).cast("array<string>")})
    settled = _settled(both, F.coalesce(c("at") - last <= _micros(keep), F.lit(False)))
    return _settled(own.where("action <> 'ready'"), F.lit(False)).unionByName(settled)


#: Rows drawn for each cell into which hot jobs are cut.
DRAWN = 32


def _cells(ready: DataFrame) -> DataFrame:
    """(_job, _cell, _from_at, _from_id, _to_at, _to_id): where a hot job's messages are cut, by time and id, so that each of
    its cells holds about as much as a shuffle partition; jobs of less have none. From a bounded sample, of which come at
    most two rows a shuffle partition. Decisions do not depend on what was drawn."""
    spark = ready.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = ready.select("job_id", "at", "message_id").sample(min(1.0, DRAWN * n / max(1, ready.count())), 42)
    cuts: dict[str, list] = {}
    for job, at, message in sorted({tuple(x) for x in sorted(map(tuple, drawn.collect()))[DRAWN::DRAWN]}):
        cuts.setdefault(job, []).append((at, message))
    out = [(job, i, *a, *b) for job, own in cuts.items() for i, (a, b) in enumerate(zip([(None, None), *own], [*own, (None, None)], strict=True))]
    kinds = {"_job": pa.string(), "_cell": pa.int32(), "_from_at": pa.int64(), "_from_id": pa.string(), "_to_at": pa.int64(), "_to_id": pa.string()}
    return spark.createDataFrame(pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds.values(), strict=True)], list(kinds)))


def _micros(keep: timedelta) -> int:
    return keep // timedelta(microseconds=1)


class Receiving(StatefulProcessor):
    """Checked messages of a job in, decisions out: state is when the job would last have been launched, and the message
    that came last. It goes when the watermark has passed all that a record forbids."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "launched long, at long, message_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not key[0].startswith("job:"):  # what is decided already
            for own in rows:
                yield own.drop(columns=["_key", "isolated"], errors="ignore")[["message_id", "at", "job_id", "action", "reason", "jobs", "model"]]
            return
        launched, at, last = self.record.get() if self.record.exists() else (None, None, None)
        out = []
        own = pd.concat(list(rows)).sort_values(["at", "message_id", "isolated", "model"], kind="stable")
        for m in own[["message_id", "at", "job_id", "isolated", "model"]].itertuples(index=False):
            if at is not None and (m.at, m.message_id) <= (at, last):
                continue
            reason = REUSED if launched is not None and m.at - launched <= self.keep else None if m.isolated else LOGIN
            if m.isolated:
                launched = int(m.at)
            at, last = int(m.at), m.message_id
            out.append((m.message_id, int(m.at), m.job_id, "reply" if reason else "launch", reason, None, None if reason else m.model))
        self.record.update((launched, at, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer((at + self.keep) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["message_id", "at", "job_id", "action", "reason", "jobs", "model"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.record.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_decisions(messages: DataFrame, r: Rules, keep: timedelta, late: str = "10 minutes") -> DataFrame:
    """The decisions of :func:`decisions` as a streaming DataFrame out of one of messages. ``arrival`` is event time: a job's
    messages must come in order from one micro-batch to the next, within one they are sorted; what is later than ``late``
    is dropped. Only ready messages meet by job; all others are dealt out evenly and leave as they are."""
    own = checked(messages.withWatermark("arrival", late), r)
    key = F.when(F.col("action") == "ready", F.concat(F.lit("job:"), "job_id")).otherwise(F.concat(F.lit("rest:"), F.pmod(F.xxhash64("message_id", "at", "reason"), F.lit(1024))))
    timed = own.withColumn("_key", key)
    found = timed.groupBy("_key").transformWithStateInPandas(Receiving(_micros(keep)), DECISION, "Append", "EventTime")
    return found.withColumn("arrival", F.timestamp_micros("at")).select("message_id", "arrival", "job_id", "action", "reason", "jobs", "model")
