"""Queries of jobs in a forest made of orders, of messages to their receiver and of replies, with the SQL that says the same."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.spread import spread
from sedge.operators import forest, receiver, replies
from sedge.operators.forest import Lane, Policy
from sedge.plans.registry import table

POLICY = Policy(
    {"research": Lane(False, ["public"]), "business": Lane(False, ["public", "ops"]), "develop": Lane(True, ["public", "ops"])}, [("adversar", "adversarial"), ("red-team", "red-team"), ("redteam", "red-team"), ("deep-iterat", "deep-iteration")],
    {"public": None, "ops": None, "confidential": "custody-confidential", "health": "custody-health"}, {"public": "public", "ops": "ops", "private": "ops", "client-raw": "confidential", "health": "health"},
)
_TAGS = {3: "web-adversarial", 4: "x--redteam", 5: "Bad Tag", 6: "deep-iter"}
_GOALS = {1: "Red team the parser", 2: "Survey café prices", 3: None}
_LANES = ("research", "business", "develop", "research", "business", "elsewhere")
_LABELS = ("Public", " OPS ", "private", "public", "client_raw", "medical", "public")
_CLAIMS = (None, "ops", None, "public", "confidential", "secret", None)


def _pick(values, by: str):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.expr(f"{by} % {len(values)}") + 1).cast("int"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: an order's parent is the one with a third of its number, but for some roots and some whose parent is
    not there; one order stands above a third of all."""
    k = F.col("job_id")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    tag = F.lit(None).cast("string")
    for n, t in _TAGS.items():
        tag = F.when(k % 61 == n, t).otherwise(tag)
    goal = F.lit("Sum up").cast("string")
    for n, g in _GOALS.items():
        goal = F.when(k % 23 == n, F.lit(g)).otherwise(goal)
    return jobs.select("job_id", F.when((k < 4) | (k % 89 == 0), None).when(k % 97 == 0, -1 - k).when(k % 3 == 1, 2).otherwise(F.floor(k / 3)).cast("long").alias("parent_id"), F.array_compact(F.array(tag, F.lit("plain"))).alias("tags"), goal.alias("goal"), _pick(_LANES, "job_id div 2").alias("lane"), _pick(_LABELS, "job_id div 3").alias("label"), _pick(_CLAIMS, "job_id div 5").alias("claimed"))


def root_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.root_classes(_jobs(spark, sf_dir), POLICY).withColumn("hits", F.array_join("hits", ","))


def custody_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.custody(_jobs(spark, sf_dir), POLICY)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _hits(c: str) -> str:
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains({c}, '{w}') THEN '{t}' END" for w, t in POLICY.stems) + "], lambda x: x IS NOT NULL)))"


_RANKS = _list(POLICY.custody)
_SQL_JOBS = f"""j AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey < 4 OR o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN -1 - o_orderkey WHEN o_orderkey % 3 = 1 THEN 2 ELSE o_orderkey // 3 END AS parent,
  CASE o_orderkey % 61 {' '.join(f"WHEN {n} THEN '{t}'" for n, t in _TAGS.items())} END AS tag, CASE o_orderkey % 23 {' '.join(f"WHEN {n} THEN {'NULL' if g is None else repr(g)}" for n, g in _GOALS.items())} ELSE 'Sum up' END AS goal,
  ({_list(_LANES)})[o_orderkey // 2 % {len(_LANES)} + 1] AS lane, ({_list(_LABELS)})[o_orderkey // 3 % {len(_LABELS)} + 1] AS label, ({_list(_CLAIMS)})[o_orderkey // 5 % {len(_CLAIMS)} + 1] AS claimed FROM orders),
up AS (SELECT id, parent AS at FROM j UNION ALL SELECT up.id, j.parent FROM up JOIN j ON j.id = up.at)"""
_LANE_OF = {name: [r for r, lane in POLICY.lanes.items() if lane.careful] if name == "careful" else list(POLICY.lanes) for name in ("careful", "all")}
ROOT_CLASSES = f"""WITH RECURSIVE {_SQL_JOBS},
h AS (SELECT *, {_hits("regexp_replace(coalesce(tag, ''), '-+', '-', 'g')")} AS own, {_hits("regexp_replace(lower(coalesce(goal, '')), '[^a-z0-9]+', '-', 'g')")} AS inferred FROM j),
a AS (SELECT up.id, list_distinct(flatten(list(h.own))) AS above FROM up JOIN h ON h.id = up.at GROUP BY up.id),
b AS (SELECT h.*, coalesce(above, []) AS above FROM h LEFT JOIN a USING (id)),
c AS (SELECT *, lane NOT IN {tuple(_LANE_OF['all'])} OR NOT coalesce(regexp_full_match(tag, '[a-z0-9][a-z0-9-]{{0,63}}'), TRUE) AS bad, lane = '{_LANE_OF['careful'][0]}' AS careful FROM b),
d AS (SELECT *, CASE WHEN careful THEN NULL WHEN len(list_filter(own, lambda x: NOT list_contains(above, x))) > 0 THEN 'carve-out' WHEN len(above) > 0 THEN 'carve-out-inherited' WHEN len(inferred) > 0 THEN 'carve-out-inferred' WHEN goal IS NULL OR contains(goal, 'é') THEN 'carve-out-uncertain' END AS reroute FROM c)
SELECT id AS job_id, CASE WHEN NOT bad THEN CASE WHEN careful OR reroute IS NOT NULL THEN 'careful' ELSE 'quick' END END AS root_class, CASE WHEN NOT bad THEN reroute END AS reroute, CASE WHEN NOT bad THEN array_to_string(list_sort(list_distinct(own || above || inferred)), ',') END AS hits, CASE WHEN bad THEN 'envelope-invalid' END AS error FROM d"""
CUSTODY_OF_JOBS = f"""WITH RECURSIVE {_SQL_JOBS},
c AS (SELECT *, CASE replace(lower(trim(label)), '_', '-') {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in POLICY.labels.items())} END AS class FROM j),
k AS (SELECT *, coalesce(claimed, class) AS claim, nullif(list_position({_RANKS}, coalesce(claimed, class)), 0) AS rank FROM c),
a AS (SELECT up.id, max(k.rank) AS above FROM up JOIN k ON k.id = up.at GROUP BY up.id),
r AS (SELECT id, claim, CASE WHEN class IS NULL THEN 'custody-label-unknown' WHEN class IN ('confidential', 'health') THEN 'custody-' || class WHEN rank IS NULL THEN 'envelope-invalid' WHEN rank < list_position({_RANKS}, class) OR rank < above THEN 'custody-widens' WHEN claim IN ('confidential', 'health') THEN 'custody-' || claim WHEN lane = 'elsewhere' THEN 'envelope-invalid' WHEN lane = 'research' AND claim = 'ops' THEN 'custody-not-admitted' END AS reason FROM k LEFT JOIN a USING (id))
SELECT id AS job_id, CASE WHEN reason IS NULL THEN claim END AS custody, reason FROM r"""

# -- messages and what a receiver does with them ---------------------------------------------------------------------

RULES = receiver.Rules(
    POLICY, {"desk:alpha:s1": True, "desk:beta:s2": False}, "T-1", {"careful": "model-c", "quick": "model-q"},
    {"careful": {"forbidden": ["bulk", "hammer"], "rule": "narrow-only"}, "quick": {"forbidden": ["bulk"], "rule": "narrow-only"}},
)
KEEP = timedelta(days=200)
_ODD = 41

# One text for both engines: an order's message as JSON, with one thing wrong in it for each remainder of its number.
_GOAL = "CASE k WHEN 9 THEN repeat('x', 6001) WHEN 15 THEN 'Rеd team' WHEN 16 THEN 'Red team it' WHEN 23 THEN '  ' ELSE 'Sum up ' || n END"
_TAG = "CASE k WHEN 14 THEN 'web-redteam' WHEN 17 THEN 'adversarial' WHEN 24 THEN 'Bad Tag' ELSE 'plain' END"
_LANE = "CASE k WHEN 13 THEN 'research' WHEN 25 THEN 'elsewhere' WHEN 26 THEN 'develop' ELSE 'business' END"
_HELD = "CASE k WHEN 27 THEN 'health' WHEN 28 THEN 'secret' ELSE 'ops' END"
_SLOW = "k IN (16, 17, 18, 26)"
_HITS = "CASE k WHEN 11 THEN '[\"red-team\",\"adversarial\"]' WHEN 16 THEN '[\"red-team\"]' WHEN 17 THEN '[\"adversarial\"]' ELSE '[]' END"
_BODY = f"""CASE WHEN k IN (1, 3, 20) THEN '{RULES.label}' || chr(10) ELSE '' END || CASE k WHEN 3 THEN '{RULES.relay} ' WHEN 29 THEN chr(10) || '[' ELSE '' END ||
CASE WHEN k IN (19, 20, 21) THEN '{{"schema":"{RULES.halt}","kind":"halt","job_id":"' || CASE k WHEN 19 THEN 'all' WHEN 20 THEN job ELSE 'job-none' END || '","reason":"stop","requested_by":"desk@x","created_at":"2026-01-01T00:00:00Z"}}'
ELSE '{{"schema":"' || CASE k WHEN 5 THEN 'other/v1' ELSE '{RULES.request}' END || '","kind":"dispatch",' || CASE k WHEN 6 THEN '"more":1,' ELSE '' END || '"envelope":{{"schema":"{RULES.envelope}","job_id":"' || job || '","parent_job_id":null,"depth":' || CASE k WHEN 7 THEN '"0"' WHEN 30 THEN '1' ELSE '0' END
  || ',"root_id":"' || CASE k WHEN 8 THEN 'job-other' ELSE job END || '","lane":"' || {_LANE} || '","tags":["' || {_TAG} || '"' || CASE k WHEN 31 THEN ',"plain"' WHEN 32 THEN ',1' ELSE '' END || '],"custody":"' || {_HELD} || '","goal":"' || {_GOAL} || '","inputs":[' || CASE k WHEN 33 THEN '{{"ref":"a"}}' WHEN 34 THEN '{{"ref":"a","sha256":"' || digest || '"}}' ELSE '' END
  || '],"allowed_effects":[' || CASE k WHEN 35 THEN '"none","read"' WHEN 36 THEN '"fly"' ELSE '"read"' END || ']' || CASE k WHEN 37 THEN ',"budget_envelope":{{}}' WHEN 38 THEN ',"budget_envelope":{{"tokens":5}}' ELSE '' END || ',"requested_by":"desk@x","created_at":"' || CASE k WHEN 39 THEN '2026-01-01' ELSE '2026-01-01T00:00:00.5Z' END || '"}}'
  || CASE k WHEN 10 THEN '' ELSE ',"resolution":{{"schema":"{RULES.resolution}","root_class":"' || CASE WHEN {_SLOW} THEN 'careful' ELSE 'quick' END || '","root_model":"' || CASE k WHEN 22 THEN 'model-x' WHEN 26 THEN 'model-q' ELSE CASE WHEN {_SLOW} THEN 'model-c' ELSE 'model-q' END END || '","reroute":null,"carve_out_hits":' || {_HITS} || ',"custody":"' || CASE k WHEN 40 THEN 'public' ELSE {_HELD} END
    || '","source_label":"Private","child_policy":{{"carve_out_tags":' || {_HITS} || ',"forbidden":' || CASE WHEN {_SLOW} THEN '["hammer","bulk"]' ELSE '["bulk"]' END || ',"rule":"narrow-only"}},"policy_rev":"r1","dedupe_key":"' || CASE k WHEN 12 THEN job ELSE key END || '","resolved_at":"2026-01-01T00:00:00Z"}}' END || '}}' END || CASE k WHEN 4 THEN ' {{}}' ELSE '' END"""
_SENDER = "CASE k WHEN 0 THEN 'desk:gamma:7:s1' WHEN 1 THEN 'desk:alpha:7:s1' WHEN 18 THEN 'desk:alpha:x:s1' ELSE 'desk:beta:7:s2' END"


def receiver_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages, a customer's orders being of one job; a third of the customers share one."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).selectExpr("o_orderkey AS n", f"o_orderkey % {2 * _ODD} AS k", "concat('job-', CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END) AS job", "o_orderdate AS arrival")
    o = o.withColumn("digest", F.sha2(F.col("job"), 256)).withColumn("key", F.sha2(F.concat("job", F.lit("\n"), F.expr(_GOAL)), 256))
    sessions = "array(named_struct('job_id', job, 'name', concat('job-', job), 'started_by', 'receiver'), named_struct('job_id', 'job-none', 'name', 'job-other', 'started_by', 'receiver'), named_struct('job_id', 'theirs', 'name', 'job-theirs', 'started_by', 'them'))"
    return o.selectExpr("lpad(n, 12, '0') AS message_id", "arrival", f"{_SENDER} AS sender", "CASE k WHEN 2 THEN 'T-2' ELSE 'T-1' END AS ticket", f"{_BODY} AS body", "k <> 1 AS bound", "n % 7 <> 0 AS isolated", f"{sessions} AS sessions")


def received_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = receiver.decisions(receiver_messages(spark, sf_dir), RULES, KEEP)
    return found.select("message_id", "job_id", "action", "reason", F.array_join("jobs", ",").alias("jobs"), "model")


def _keys(path: str, need, may=()) -> str:
    """That an object has all of ``need`` and nothing but both."""
    there = f"coalesce(json_keys(v, '{path}'), ['?'])"
    return f"coalesce(json_type(v, '{path}') = 'OBJECT' AND list_has_all({there}, {_list(need)}) AND list_has_all({_list([*need, *may])}, {there}), FALSE)"


def _matches(path: str, pattern: str) -> str:
    return f"coalesce(json_type(v, '{path}') = 'VARCHAR' AND regexp_full_match(v->>'{path}', '{pattern}'), FALSE)"


_E, _R = "$.envelope.", "$.resolution."
_ID = "[a-z0-9][a-z0-9-]{2,63}"
_UTC = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z"
_CHILD = " OR ".join(f"(v->>'{_R}root_class' = '{k}' AND list_sort(CAST(v->'{_R}child_policy.forbidden' AS VARCHAR[])) = {_list(sorted(x['forbidden']))} AND v->>'{_R}child_policy.rule' = '{x['rule']}')" for k, x in RULES.children.items())
_SQL_ENVELOPE = " AND ".join([
    _keys("$.envelope", receiver.ENVELOPE_KEYS, ["budget_envelope"]), f"coalesce(v->>'{_E}schema' = '{RULES.envelope}', FALSE)", _matches(_E + "job_id", _ID), _matches(_E + "root_id", _ID), f"coalesce(json_type(v, '{_E}depth') = 'UBIGINT', FALSE)",
    f"coalesce(CASE WHEN v->>'{_E}depth' = '0' THEN json_type(v, '{_E}parent_job_id') = 'NULL' AND v->>'{_E}root_id' = v->>'{_E}job_id' ELSE json_type(v, '{_E}parent_job_id') = 'VARCHAR' END, FALSE)", f"coalesce(v->>'{_E}lane' IN {tuple(POLICY.lanes)}, FALSE)", f"coalesce(v->>'{_E}custody' IN {tuple(POLICY.custody)}, FALSE)",
    f"coalesce(len(list_distinct(tags)) = len(tags) AND len(list_filter(CAST(v->'{_E}tags' AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) = 0 AND len(list_filter(tags, lambda x: NOT regexp_full_match(x, '[a-z0-9][a-z0-9-]{{0,63}}'))) = 0, FALSE)", f"coalesce(trim(goal) <> '' AND octet_length(encode(goal)) <= 6000, FALSE)",
    f"coalesce(json_array_length(v, '{_E}inputs') = 0 OR (" + _keys(_E + "inputs[0]", ["ref", "sha256"]) + f" AND regexp_full_match(v->>'{_E}inputs[0].sha256', '[0-9a-f]{{64}}')), FALSE)", f"coalesce(len(effects) > 0 AND list_has_all({_list(RULES.effects)}, effects) AND (NOT list_contains(effects, 'none') OR len(effects) = 1), FALSE)",
    f"(json_type(v, '{_E}budget_envelope') IS NULL OR coalesce((v->>'{_E}budget_envelope.tokens')::BIGINT >= 1, FALSE))", _matches(_E + "created_at", _UTC),
])
_SQL_RESOLUTION = " AND ".join([
    _keys("$.resolution", receiver.RESOLUTION_KEYS), _keys(_R + "child_policy", ["carve_out_tags", "forbidden", "rule"]), "coalesce(list_sort(list_distinct(hits)) = hits, FALSE)", f"coalesce(v->>'{_R}child_policy.carve_out_tags' = v->>'{_R}carve_out_hits', FALSE)", f"coalesce({_CHILD}, FALSE)",
    f"coalesce(v->>'{_R}custody' = v->>'{_E}custody', FALSE)", f"coalesce(v->>'{_R}dedupe_key' = sha256((v->>'{_E}root_id') || chr(10) || goal), FALSE)",
])
RECEIVED_MESSAGES = f"""WITH o AS (SELECT o_orderkey AS n, o_orderkey % {2 * _ODD} AS k, 'job-' || CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS job, o_orderdate AS arrival FROM orders),
q AS (SELECT *, sha256(job) AS digest, sha256(job || chr(10) || {_GOAL}) AS key FROM o),
m AS (SELECT lpad(n::VARCHAR, 12, '0') AS message_id, arrival, job AS ours, {_SENDER} AS sender, CASE k WHEN 2 THEN 'T-2' ELSE 'T-1' END AS ticket, {_BODY} AS body, k <> 1 AS bound, n % 7 <> 0 AS isolated FROM q),
t AS (SELECT *, CASE WHEN starts_with(body, '{RULES.label}' || chr(10)) THEN substr(body, {len(RULES.label) + 2}) ELSE body END AS text FROM m),
p AS (SELECT *, CASE WHEN json_valid(text) THEN text::JSON END AS v FROM t),
x AS (SELECT *, v->>'{_E}goal' AS goal, CAST(v->'{_E}tags' AS VARCHAR[]) AS tags, CAST(v->'{_E}allowed_effects' AS VARCHAR[]) AS effects, CAST(v->'{_R}carve_out_hits' AS VARCHAR[]) AS hits FROM p),
h AS (SELECT *, list_sort(list_distinct({_hits("coalesce(array_to_string(tags, ' '), '')")} || {_hits("regexp_replace(lower(coalesce(goal, '')), '[^a-z0-9]+', '-', 'g')")})) AS own FROM x),
c AS (SELECT *, v->>'{_E}lane' = '{_LANE_OF['careful'][0]}' OR len(own) > 0 OR regexp_matches(goal, '[^\x00-\x7F]') AS careful FROM h),
d AS (SELECT *, CASE WHEN NOT regexp_full_match(sender, '[^:]+:[^:]+:[0-9]+:[^:]+') OR regexp_replace(sender, ':[0-9]+:', ':') NOT IN {tuple(RULES.senders)} THEN 'sender-not-allowed' WHEN starts_with(sender, 'desk:alpha:') AND NOT bound THEN 'sender-unbound' WHEN ticket <> 'T-1' THEN 'ticket-not-allowed' END AS dropped,
  CASE WHEN starts_with(text, '{RULES.relay}') OR v IS NULL OR json_type(v) <> 'OBJECT' THEN 'request-invalid' WHEN v->>'$.schema' = '{RULES.halt}' THEN CASE WHEN v->>'$.job_id' NOT IN ('all', ours) THEN 'halt-job-unknown' END
  WHEN v->>'$.schema' <> '{RULES.request}' OR NOT {_keys('$', ['schema', 'kind'], ['envelope', 'resolution'])} THEN 'request-invalid' WHEN NOT ({_SQL_ENVELOPE}) THEN 'envelope-invalid' WHEN json_type(v, '$.resolution') IS NULL THEN 'resolution-missing' WHEN NOT ({_SQL_RESOLUTION}) THEN 'resolution-invalid'
  WHEN v->>'{_E}custody' IN ('confidential', 'health') THEN 'custody-' || (v->>'{_E}custody') WHEN v->>'{_E}lane' = 'research' AND v->>'{_E}custody' <> 'public' THEN 'custody-not-admitted' WHEN (v->>'{_R}root_class') <> CASE WHEN careful THEN 'careful' ELSE 'quick' END OR hits <> own THEN 'resolution-disagrees'
  WHEN careful AND v->>'{_R}root_model' <> 'model-c' THEN 'resolution-disagrees' WHEN NOT careful AND v->>'{_R}root_model' <> 'model-q' THEN 'model-mismatch' END AS refused FROM c),
e AS (SELECT *, CASE WHEN dropped IS NOT NULL THEN 'drop' WHEN refused IS NOT NULL THEN 'reply' WHEN v->>'$.schema' = '{RULES.halt}' THEN 'halt' ELSE 'ready' END AS action FROM d),
r AS (SELECT *, CASE WHEN action = 'ready' THEN v->>'{_E}job_id' END AS job_id, max(arrival) FILTER (isolated) OVER (PARTITION BY action, v->>'{_E}job_id' ORDER BY arrival, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
s AS (SELECT *, CASE WHEN action <> 'ready' THEN coalesce(dropped, refused) WHEN arrival - last <= INTERVAL {KEEP.days} DAY THEN 'job-id-reused' WHEN NOT isolated THEN 'login-isolation' END AS reason FROM r)
SELECT message_id, job_id, CASE WHEN action <> 'ready' THEN action WHEN reason IS NULL THEN 'launch' ELSE 'reply' END AS action, reason, CASE WHEN action = 'halt' THEN CASE WHEN v->>'$.job_id' = 'all' THEN ours ELSE v->>'$.job_id' END END AS jobs, CASE WHEN action = 'ready' AND reason IS NULL THEN v->>'{_R}root_model' END AS model FROM s"""

# -- replies that must fit a size ------------------------------------------------------------------------------------

_LIMIT, _PROTECTED = 420, "m-1.*"
_ENTRY = """'{"model":"m-' || o_orderpriority || '","unit":"' || CASE WHEN o_orderkey % 9 = 0 THEN 'root' ELSE 'é' || o_orderkey END || '"}'"""
_HEAD = """'{"detail":"' || repeat('d', CASE WHEN job % 13 = 0 THEN 500 ELSE 9 END) || '","job_id":"job-' || job || '","kind":"done","receipt":{"observed_models":['"""


def trimmed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the models that a reply lists, by number: what goes so that it fits."""
    entries = table(spark, sf_dir, "orders").selectExpr("o_custkey AS job", "struct(o_orderkey AS o, " + _ENTRY + " AS e) AS x").groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), ",").alias("list"))
    made = entries.selectExpr("job", _HEAD + """ || list || ']},"schema":"s"}' AS reply""", "sha2(cast(job AS string), 256) AS receipt_sha256")
    return replies.trim(made, _LIMIT, _PROTECTED).select("job", "action", F.col("omitted").cast("long").alias("omitted"), F.when(F.col("action") != "too-large", F.col("wire")).alias("wire"))


TRIMMED_REPLIES = f"""WITH e AS (SELECT o_custkey AS job, o_orderkey AS o, {_ENTRY} AS e, NOT (o_orderkey % 9 = 0 OR regexp_full_match('m-' || o_orderpriority, '{_PROTECTED}')) AS free FROM orders),
w AS (SELECT *, octet_length(encode(e)) + 1 AS size, CASE WHEN free THEN count(*) FILTER (free) OVER z END AS k, coalesce(sum(CASE WHEN free THEN octet_length(encode(e)) + 1 END) OVER z, 0) AS saved FROM e WINDOW z AS (PARTITION BY job ORDER BY o DESC ROWS UNBOUNDED PRECEDING)),
g AS (SELECT job, count(*) AS n, {_HEAD} || string_agg(e, ',' ORDER BY o) || ']}},"schema":"s"}}' AS reply FROM e GROUP BY job),
h AS (SELECT *, octet_length(encode(reply)) AS whole FROM g),
t AS (SELECT job, min(k) AS k FROM w JOIN h USING (job) WHERE free AND whole > {_LIMIT} AND whole - saved + length(',"trimmed":{{"observed_models_omitted":' || k || ',"receipt_sha256":""}}') + 64 + CASE WHEN k = n THEN 1 ELSE 0 END <= {_LIMIT} GROUP BY job),
s AS (SELECT t.job, t.k, {_HEAD.replace("job %", "t.job %").replace("|| job ||", "|| t.job ||")} || coalesce(string_agg(e, ',' ORDER BY o) FILTER (NOT free OR w.k > t.k), '') || ']}},"schema":"s","trimmed":{{"observed_models_omitted":' || t.k || ',"receipt_sha256":"' || sha256(t.job::VARCHAR) || '"}}}}' AS wire FROM t JOIN w USING (job) GROUP BY t.job, t.k)
SELECT h.job, CASE WHEN whole <= {_LIMIT} THEN 'sent' WHEN s.job IS NOT NULL THEN 'trimmed' ELSE 'too-large' END AS action, s.k AS omitted, CASE WHEN whole <= {_LIMIT} THEN reply ELSE s.wire END AS wire FROM h LEFT JOIN s ON s.job = h.job"""

_ALL = (root_classes, custody_of_jobs, received_messages, trimmed_replies)

QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {name: sql for name in QUERIES if (sql := globals().get(name.upper()))}
