"""Queries of streamed answers, event logs, usage records and JSON sources; and the SQL that says the same.

Their inputs are made of the events table: each user's events are a stream, a log or a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.spread import dealt, spread
from sedge.functions.udfs import canonical_json, hmac_hex, strict_json
from sedge.operators import chatlog, ledger, requests, rules, usage
from sedge.plans.registry import FINDINGS, SQL_INJECTION, SQL_URL, sql_redacted, table
from sedge.sources import readers, sinks
from sedge.streaming import appends, sse
from sedge.streaming import chunks as chunked

# -- answers ---------------------------------------------------------------------------------------------------------


def _json(**fields: Column | str | int) -> Column:
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, (str, int)) else v).alias(k) for k, v in fields.items()]))


_FALLBACK = '{"type":"fallback","from":{"model":"m"},"to":{"model":"n"},"trigger":null}'
_SERVED = '"iterations":[3,{"type":"fallback_message","model":"n","input_tokens":1,"output_tokens":1,"cache_creation_input_tokens":0,"cache_read_input_tokens":0}],'


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, pos, data): a message for each user, a content block for each event, and by the user's number modulo 16:
    1 no stop, 2 a repeated block, 3 a refusal, 4 a fallback block, 5 text into a fallback block, 6 an odd model, 8 indices in
    quotes, 9 a usage that is a number, 10 a reason that is a number, 11 counts in quotes, 12 an event that is cut off, 13 a
    fallback that served, 14 an event that is a list, 15 two values in an event."""
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    k, n = F.col("user_id") % 16, F.col("n")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    block = F.when(k.isin(4, 5, 13) & (n == 1), F.lit(_FALLBACK)).otherwise('{"type":"text"}')
    start = text('{"type":"content_block_start","index":', F.when(k == 8, text('"', n, '"')).when((k == 2) & (n > 1), (n - 1).cast("string")).otherwise(n.cast("string")), ',"content_block":', block, "}")
    odd = {12: '{"type":"ping"', 14: "[1]", 15: '{"type":"ping"} {}'}
    delta = F.when(~k.isin(4, 13) | (n > 1), text('{"type":"content_block_delta","index":', n, "}"))
    for at, data in odd.items():
        delta = F.when(k == at, F.lit(data)).otherwise(delta)
    stop = text('{"type":"content_block_stop","index":', n, "}")
    blocks = e.select("user_id", F.posexplode(F.array(start, delta, stop)).alias("p", "data"), (n * 3 + 10).alias("at")).select("user_id", (F.col("at") + F.col("p")).alias("pos"), "data").where("data is not null")
    users = e.groupBy("user_id").agg(F.count("*").alias("n"))
    first = users.select("user_id", F.lit(0).alias("pos"), text('{"type":"message_start","message":{"model":"', F.when(k == 6, "a b").otherwise("m"), '","usage":', F.when(k == 9, F.lit("5")).otherwise(text('{"input_tokens":', F.when(k == 11, text('"', n, '"')).otherwise(n.cast("string")), "}")), "}}").alias("data"))
    reason = F.when(k == 3, '"refusal","stop_details":{"type":"refusal","category":"bio"}').when(k == 10, "7").otherwise('"end_turn"')
    end = users.select("user_id", F.lit(10**9).alias("pos"), text('{"type":"message_delta","delta":{"stop_reason":', reason, '},"usage":{', F.when(k == 13, _SERVED).otherwise(""), '"output_tokens":', n * 2, "}}").alias("data"))
    last = users.where(k != 1).select("user_id", F.lit(10**9 + 1).alias("pos"), F.lit('{"type":"message_stop"}').alias("data"))
    return first.unionByName(blocks).unionByName(end).unionByName(last).select(F.concat(F.lit("s"), "user_id").alias("stream_id"), "pos", "data")


def answer_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sse.messages_telemetry(_answers(spark, sf_dir))


def chunked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers as raw chunks of 7 to 47 bytes, a third of which come twice, framed and judged."""
    text = F.concat(F.lit("event: x\r\n: é\ndata: "), F.regexp_replace("data", ",", ",\r\ndata: "), F.lit("\r\n\r\n"))
    streams = dealt(_answers(spark, sf_dir), "stream_id").groupBy("stream_id").agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x.t), ""), "utf-8").alias("raw"))
    sized = streams.withColumn("size", (F.pmod(F.crc32("stream_id"), F.lit(41)) + 7).cast("int")).withColumn("n", F.expr("sequence(0, cast(octet_length(raw) div size as int))"))
    # cut before they are exploded, so that no chunk's row carries the whole stream along
    chunks = sized.select("stream_id", F.explode(F.expr("transform(concat(n, filter(n, i -> i % 3 = 0)), i -> named_struct('seq', i, 'chunk', substring(raw, i * size + 1, size)))")).alias("c"))
    return sse.messages_telemetry(chunked.chunk_frames(chunks.select("stream_id", "c.*")))


_INT = "json_type(j, '$.{0}') = 'UBIGINT'"
_MODEL_OK = "coalesce(json_type(j, '$.{0}') = 'VARCHAR' AND regexp_full_match(j->>'$.{0}', '[A-Za-z0-9][A-Za-z0-9._:/@-]{{0,127}}'), FALSE)"
ANSWER_TELEMETRY = f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, user_id % 16 AS k FROM events),
u AS (SELECT user_id, count(*) AS n, user_id % 16 AS k FROM events GROUP BY user_id),
d AS (SELECT user_id, 0::BIGINT AS pos, '{{"type":"message_start","message":{{"model":"' || CASE k WHEN 6 THEN 'a b' ELSE 'm' END || '","usage":' || CASE k WHEN 9 THEN '5' WHEN 11 THEN '{{"input_tokens":"' || n || '"}}' ELSE '{{"input_tokens":' || n || '}}' END || '}}}}' AS data FROM u
  UNION ALL SELECT user_id, n * 3 + 10, '{{"type":"content_block_start","index":' || CASE WHEN k = 8 THEN '"' || n || '"' WHEN k = 2 AND n > 1 THEN (n - 1)::VARCHAR ELSE n::VARCHAR END || ',"content_block":' || CASE WHEN k IN (4, 5, 13) AND n = 1 THEN '{_FALLBACK}' ELSE '{{"type":"text"}}' END || '}}' FROM e
  UNION ALL SELECT user_id, n * 3 + 11, CASE k WHEN 12 THEN '{{"type":"ping"' WHEN 14 THEN '[1]' WHEN 15 THEN '{{"type":"ping"}} {{}}' ELSE '{{"type":"content_block_delta","index":' || n || '}}' END FROM e WHERE k NOT IN (4, 13) OR n > 1
  UNION ALL SELECT user_id, n * 3 + 12, '{{"type":"content_block_stop","index":' || n || '}}' FROM e
  UNION ALL SELECT user_id, 1000000000, '{{"type":"message_delta","delta":{{"stop_reason":' || CASE k WHEN 3 THEN '"refusal","stop_details":{{"type":"refusal","category":"bio"}}' WHEN 10 THEN '7' ELSE '"end_turn"' END || '}},"usage":{{' || CASE k WHEN 13 THEN '{_SERVED}' ELSE '' END || '"output_tokens":' || n * 2 || '}}}}' FROM u
  UNION ALL SELECT user_id, 1000000001, '{{"type":"message_stop"}}' FROM u WHERE k <> 1),
j AS (SELECT user_id, pos, CASE WHEN json_valid(data) THEN data::JSON END AS j FROM d),
x AS (SELECT user_id, pos, coalesce(json_type(j) = 'OBJECT', FALSE) AS sound, CASE WHEN json_type(j, '$.type') = 'VARCHAR' THEN j->>'$.type' ELSE '' END AS kind, CASE WHEN {_INT.format('index')} THEN (j->>'$.index')::BIGINT END AS block,
    {_MODEL_OK.format('message.model')} AND json_type(j, '$.message.usage') = 'OBJECT' AS ok_start, json_type(j, '$.content_block.type') = 'VARCHAR' AS ok_block, coalesce(j->>'$.content_block.type' = 'fallback', FALSE) AS fallback,
    {_MODEL_OK.format('content_block.from.model')} AND {_MODEL_OK.format('content_block.to.model')} AND coalesce(json_type(j, '$.content_block.trigger') = 'NULL', TRUE) AS ok_fallback, json_type(j, '$.delta.stop_reason') = 'VARCHAR' AND json_type(j, '$.usage') = 'OBJECT' AS ok_delta, j FROM j),
w AS (SELECT *, count(*) FILTER (kind = 'message_start') OVER b AS started, count(*) FILTER (kind = 'message_delta') OVER b AS final, count(*) FILTER (kind = 'message_stop') OVER b AS stopped, count(*) FILTER (kind = 'content_block_start') OVER b AS opens, count(*) FILTER (kind = 'content_block_stop') OVER b AS closes,
    count(*) FILTER (kind = 'content_block_start') OVER o AS opened, count(*) FILTER (kind = 'content_block_stop') OVER o AS closed, count(*) FILTER (kind = 'content_block_start' AND fallback) OVER o AS into_fallback FROM x
  WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY user_id, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, NOT sound OR stopped > 0 OR coalesce(CASE kind WHEN 'message_start' THEN started > 0 OR NOT coalesce(ok_start, FALSE) WHEN 'content_block_start' THEN started = 0 OR final > 0 OR block IS NULL OR opened > 0 OR NOT coalesce(ok_block, FALSE) OR (fallback AND NOT ok_fallback)
    WHEN 'content_block_delta' THEN block IS NULL OR opened = 0 OR closed > 0 OR into_fallback > 0 WHEN 'content_block_stop' THEN block IS NULL OR opened = 0 OR closed > 0 WHEN 'message_delta' THEN started = 0 OR final > 0 OR opens <> closes OR NOT coalesce(ok_delta, FALSE) WHEN 'message_stop' THEN started = 0 OR final = 0 END, FALSE) AS wrong FROM w),
g AS (SELECT user_id, bool_or(kind = 'message_stop') AND NOT bool_or(wrong) AS complete, count(*) FILTER (kind = 'error') AS errors, arg_max(CASE kind WHEN 'message_start' THEN j->>'$.message.model' ELSE j->>'$.content_block.to.model' END, pos) FILTER (kind = 'message_start' OR (kind = 'content_block_start' AND fallback)) AS model,
    max(j->>'$.delta.stop_reason') FILTER (kind = 'message_delta') AS stop_reason, max(j->>'$.delta.stop_details.category') FILTER (kind = 'message_delta') AS category, max((j->>'$.message.usage.input_tokens')::BIGINT) FILTER (kind = 'message_start' AND {_INT.format('message.usage.input_tokens')}) AS i, max((j->>'$.usage.output_tokens')::BIGINT) FILTER (kind = 'message_delta' AND {_INT.format('usage.output_tokens')}) AS o,
    count(*) FILTER (kind = 'content_block_start' AND fallback) AS transitions, bool_or(kind = 'message_delta' AND json_type(j, '$.usage.iterations') IS NOT NULL) AS answered FROM y GROUP BY user_id)
SELECT 's' || user_id AS stream_id, complete, errors, CASE WHEN complete THEN model END AS model, CASE WHEN complete THEN stop_reason END AS stop_reason, CASE WHEN complete AND stop_reason = 'refusal' THEN category END AS refusal_category, CASE WHEN complete THEN i END AS input_tokens, CASE WHEN complete THEN o END AS output_tokens,
NULL::BIGINT AS cache_creation_input_tokens, NULL::BIGINT AS cache_read_input_tokens, CASE WHEN complete THEN transitions ELSE 0 END AS fallback_transitions, complete AND answered AND stop_reason <> 'refusal' AS fallback_served FROM g"""
CHUNKED_ANSWERS = ANSWER_TELEMETRY


def framed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole event texts of the other protocol, a user each: purchases complete, signups fail, comments and an unfinished
    event stand between; a user whose number 6 divides sends a line over the bounds."""
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value").cast("long"))
    done = F.concat(F.lit('event: response.completed\r\ndata: {"type":"response.completed",\r\ndata: "response":{"model":"m-1","usage":{"input_tokens":'), F.col("v").cast("string"), F.lit(',"output_tokens":2,"total_tokens":"x"}}}\r\n\r\n'))
    one = F.when(F.col("event_type") == "purchase", done).when(F.col("event_type") == "signup", 'data: {"type":"response.failed"}\n\n').otherwise(": a comment\n\n")
    text = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("t")))), lambda x: x.t), "").alias("t"))
    long = F.when(F.col("user_id") % 6 == 0, F.concat(F.lit("data: "), F.repeat(F.lit("x"), sse.MAX_LINE), F.lit("\n\n"))).otherwise("")
    texts = text.select(F.concat(F.lit("s"), "user_id").alias("stream_id"), F.concat(long, "t", F.lit('data: {"type":"response.completed","response":{}}')).alias("text"))
    return sse.responses_telemetry(sse.frames(texts)).select("stream_id", "complete", "errors", "model", "input_tokens", "output_tokens", "total_tokens")


FRAMED_RESPONSES = """WITH u AS (SELECT user_id, arg_max(floor(value)::BIGINT, event_id) FILTER (event_type = 'purchase') AS v, count(*) FILTER (event_type = 'signup') AS errors, count(*) FILTER (event_type IN ('purchase', 'signup')) AS k FROM events GROUP BY user_id)
SELECT 's' || user_id AS stream_id, v IS NOT NULL AND user_id % 6 <> 0 AS complete, errors, CASE WHEN v IS NOT NULL AND user_id % 6 <> 0 THEN 'm-1' END AS model, CASE WHEN user_id % 6 <> 0 THEN v END AS input_tokens, CASE WHEN v IS NOT NULL AND user_id % 6 <> 0 THEN 2 END AS output_tokens, NULL::BIGINT AS total_tokens FROM u WHERE k > 0 OR user_id % 6 = 0"""


def request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as requests of both protocols: each purchase is the result of a call, whose id is the whole part of its value,
    declared before it in one protocol and anywhere in the other; other events are the calls."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.col("value") / 10).cast("string").alias("id"))
    tool = F.when(F.col("event_type") == "click", "mcp__linear__get").when(F.col("event_type") == "view", "Bash").otherwise("Unknown")
    result = F.col("event_type") == "purchase"
    use = F.concat(F.lit('{"role":"assistant","content":[{"type":"tool_use","id":"'), "id", F.lit('","name":"'), tool, F.lit('"}]}'))
    back = F.concat(F.lit('{"role":"user","content":[{"type":"tool_result","tool_use_id":"'), "id", F.lit('","content":[{"type":"text","text":"'), F.col("event_id").cast("string"), F.lit('"},{"type":"image"}]}]}'))
    call = F.concat(F.lit('{"type":"function_call","call_id":"'), "id", F.lit('","name":"'), tool, F.lit('"}'))
    out = F.concat(F.lit('{"type":"function_call_output","call_id":"'), "id", F.lit('","output":"'), F.col("event_id").cast("string"), F.lit('"}'))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", c.alias("b")))), lambda x: x.b), ",")
    b = e.groupBy(F.col("user_id").alias("request")).agg(F.concat(F.lit('{"messages":['), joined(F.when(result, back).otherwise(use)), F.lit("]}")).alias("m"), F.concat(F.lit('{"input":['), joined(F.when(result, out).otherwise(call)), F.lit("]}")).alias("r"))
    return requests.messages_documents(b, "m", 64).unionByName(requests.responses_documents(b, "r", 64))


REQUEST_DOCUMENTS = """WITH e AS (SELECT user_id AS request, event_id AS pos, floor(value / 10)::BIGINT::VARCHAR AS id, CASE event_type WHEN 'click' THEN 'mcp__linear__get' WHEN 'view' THEN 'Bash' WHEN 'purchase' THEN NULL ELSE 'Unknown' END AS tool FROM events),
m AS (SELECT 'anthropic' AS p, r.request, r.pos, r.id, min(c.tool) AS tool FROM e r JOIN e c ON r.request = c.request AND r.id = c.id AND c.pos < r.pos AND c.tool IS NOT NULL WHERE r.tool IS NULL GROUP BY ALL HAVING count(DISTINCT c.tool) = 1),
o AS (SELECT 'openai' AS p, r.request, r.pos, r.id, min(c.tool) AS tool FROM e r JOIN e c ON r.request = c.request AND r.id = c.id AND c.tool IS NOT NULL WHERE r.tool IS NULL GROUP BY ALL HAVING count(*) = 1),
t AS (SELECT *, CASE tool WHEN 'Bash' THEN 'Bash' ELSE 'mcp:linear' END AS source, CASE tool WHEN 'Bash' THEN 'untrusted_tool_output' ELSE 'semi_trusted_service' END AS trust_tier FROM (FROM m UNION ALL FROM o) WHERE tool <> 'Unknown'),
n AS (SELECT *, row_number() OVER (PARTITION BY p, request ORDER BY pos)::INT AS ordinal FROM t)
SELECT request, ordinal, p || ':' || source || ':' || left(sha256(id), 16) || ':' || CASE p WHEN 'openai' THEN ordinal - 1 ELSE 0 END AS source, trust_tier, pos::VARCHAR AS body FROM n WHERE ordinal <= 64"""


def log_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a run's log; which rules of its grammar it breaks."""
    names = {"view": "doc", "click": "card", "purchase": "end", "signup": "summary"}
    event = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in names.items()], F.lit("manifest"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), event.alias("event"), F.when(event.isin("doc", "card", "end"), F.floor(F.col("event_id") / 4)).alias("doc"))
    return sse.event_log_errors(log.withColumnRenamed("run", "run_id")).select("run_id", F.array_join("errors", ",").alias("errors"))


LOG_GRAMMAR = """WITH e AS (SELECT user_id AS r, event_id AS pos, CASE event_type WHEN 'view' THEN 'doc' WHEN 'click' THEN 'card' WHEN 'purchase' THEN 'end' WHEN 'signup' THEN 'summary' ELSE 'manifest' END AS ev FROM events),
d AS (SELECT *, CASE WHEN ev IN ('doc', 'card', 'end') THEN pos // 4 END AS doc FROM e),
w AS (SELECT *, coalesce(sum((ev = 'doc')::INT - (ev = 'end')::INT) OVER b, 0) AS o, coalesce(sum((ev = 'summary')::INT) OVER b, 0) AS s, coalesce(sum((ev = 'manifest')::INT) OVER b, 0) AS m, lag(doc) OVER (PARTITION BY r ORDER BY pos) AS prev FROM d WINDOW b AS (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT r, unnest([CASE WHEN ev = 'doc' AND o <> 0 THEN 'doc-inside-doc' END, CASE WHEN ev = 'card' AND (o <> 1 OR doc IS DISTINCT FROM prev) THEN 'card-outside-doc' END, CASE WHEN ev = 'end' AND (o <> 1 OR doc IS DISTINCT FROM prev) THEN 'end-outside-doc' END,
  CASE WHEN ev = 'summary' AND (o <> 0 OR s > 0) THEN 'summary-early' END, CASE WHEN ev = 'manifest' AND (s <> 1 OR m > 0) THEN 'manifest-early' END, CASE WHEN m > 0 THEN 'after-manifest' END]) AS error FROM w
  UNION ALL SELECT r, CASE WHEN count(*) FILTER (ev = 'manifest') <> 1 THEN 'no-manifest' END FROM w GROUP BY r)
SELECT r AS run_id, string_agg(DISTINCT error, ',' ORDER BY error) AS errors FROM x WHERE error IS NOT NULL GROUP BY r"""

# -- usage -----------------------------------------------------------------------------------------------------------


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as usage records: quantities for tokens, some unknown, some beyond their whole."""
    i = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return i.select(
        F.col("l_orderkey").alias("bind"), n.alias("line"), F.col("l_partkey").alias("request"), F.when(n == 1, "baseline").when(n == 2, "candidate").otherwise("more").alias("variant"),
        F.when(q % 11 != 0, q).alias("input_tokens"), F.when(n % 3 != 0, F.col("l_suppkey") % 40).alias("cached_input_tokens"), F.when(n % 4 == 0, F.lit(-1).cast("long")).alias("cache_write_tokens"),
        (q + n).alias("output_tokens"), F.when(n % 2 == 0, n * 5).alias("reasoning_output_tokens"), F.when(n != 5, 2 * q + n).alias("total_tokens"),
    )


SQL_USAGE = """l AS (SELECT l_orderkey AS bind, l_linenumber::BIGINT AS line, l_partkey AS request, CASE l_linenumber WHEN 1 THEN 'baseline' WHEN 2 THEN 'candidate' ELSE 'more' END AS variant, l_quantity::BIGINT AS q, l_suppkey FROM lineitem),
g AS (SELECT bind, line, request, variant, CASE WHEN q % 11 <> 0 THEN q END AS input_tokens, CASE WHEN line % 3 <> 0 THEN l_suppkey % 40 END AS cached_input_tokens, CASE WHEN line % 4 = 0 THEN -1 END AS cache_write_tokens,
  q + line AS output_tokens, CASE WHEN line % 2 = 0 THEN line * 5 END AS reasoning_output_tokens, CASE WHEN line <> 5 THEN 2 * q + line END AS total_tokens FROM l)"""


def usage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.checked(_usage(spark, sf_dir)).select("bind", "line", F.array_join("errors", ",").alias("errors"), F.array_join("omitted_fields", ",").alias("omitted"))


USAGE_CHECKS = f"""WITH {SQL_USAGE}
SELECT bind, line, concat_ws(',', CASE WHEN input_tokens IS NULL THEN 'input-unknown' END, CASE WHEN cache_write_tokens < 0 THEN 'negative' END, CASE WHEN cached_input_tokens > input_tokens THEN 'cached-over-input' END, CASE WHEN reasoning_output_tokens > output_tokens THEN 'reasoning-over-output' END, CASE WHEN total_tokens <> input_tokens + output_tokens THEN 'total-mismatch' END) AS errors,
concat_ws(',', {', '.join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in usage.FIELDS)}) AS omitted FROM g"""


def usage_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.compare(_usage(spark, sf_dir), ["bind"], ["request"]).select("bind", "base_request", "cand_request", *[f"{f}_savings" for f in usage.FIELDS])


USAGE_COMPARISON = f"""WITH {SQL_USAGE} SELECT a.bind, a.request AS base_request, b.request AS cand_request, {', '.join(f'CASE WHEN a.{f} > 0 THEN (a.{f} - b.{f}) / a.{f} END AS {f}_savings' for f in usage.FIELDS)}
FROM g a JOIN g b ON a.bind = b.bind AND a.variant = 'baseline' AND b.variant = 'candidate' AND a.request <> b.request"""


def response_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed responses, bare and in a completion event, and others that are none, as strict JSON artifacts."""
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value").cast("string"))
    body = F.concat(F.lit('{"object":"response","model":"m","status":"'), F.when(F.col("event_type") == "view", "failed").otherwise("completed"), F.lit('","usage":{"input_tokens":'), "v", F.lit(',"input_tokens_details":{"cached_tokens":1},"output_tokens":3}}'))
    whole = F.when(F.col("event_type") == "click", F.concat(F.lit('{"type":"response.completed","response":'), body, F.lit("}"))).when(F.col("event_type") == "signup", F.concat(F.lit('{"a":1,"a":2,"b":'), body, F.lit("}"))).otherwise(body)
    files = e.select(F.col("event_id").alias("source"), F.encode(whole, "UTF-8").alias("content")).withColumn("bytes", F.octet_length("content"))
    return readers.completed_response(readers.strict_artifacts(files)).select("source", "error", "usage_error", "model", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")


RESPONSE_SOURCES = """WITH e AS (SELECT event_id AS source, event_type AS t, floor(value)::BIGINT AS v, event_type NOT IN ('view', 'signup') AS ok FROM events)
SELECT source, CASE WHEN t = 'signup' THEN 'not-strict-json' END AS error, CASE WHEN NOT ok THEN 'not-a-completed-response' END AS usage_error, CASE WHEN t <> 'signup' THEN 'm' END AS model, CASE WHEN ok THEN v END AS input_tokens, CASE WHEN ok THEN 1 END AS cached_input_tokens, CASE WHEN ok THEN 3 END AS output_tokens, NULL::BIGINT AS total_tokens FROM e"""


def agent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, five at a time, as agents' logs: purchases complete a turn, views are messages; only logs of one
    turn with a message are valid."""
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value").cast("string")).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    value = F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"type":"turn.completed","usage":{"input_tokens":'), "v", F.lit(',"output_tokens":2}}'))).when(F.col("event_type") == "view", F.concat(F.lit('{"type":"item.completed","item":{"type":"agent_message","text":"said '), "event_id", F.lit('"}}'))).otherwise('{"type":"other"}')
    return readers.agent_turns(e.select(F.format_string("%d/%d", "user_id", F.floor((F.col("n") - 1) / 5)).alias("source"), F.col("event_id").alias("pos"), value.alias("value")))


AGENT_LOGS = """WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS b FROM events),
u AS (SELECT user_id || '/' || b AS source, count(*) FILTER (event_type = 'purchase') AS k, max(event_id) FILTER (event_type = 'view') AS m, arg_max(floor(value)::BIGINT, event_id) FILTER (event_type = 'purchase') AS v FROM e GROUP BY user_id, b),
o AS (SELECT *, k = 1 AND m IS NOT NULL AS ok FROM u)
SELECT source, ok AS valid, CASE WHEN ok THEN 'said ' || m END AS final_message, CASE WHEN ok THEN v END AS input_tokens, NULL::BIGINT AS cached_input_tokens, CASE WHEN ok THEN 2 END AS output_tokens FROM o"""


def last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"type":"result","id":'), "event_id", F.lit("}"))).when(F.col("event_type") == "click", '{"type":"system","subtype":"api_retry"}').otherwise('{"type":"system"}')
    return readers.last_result(e.select(F.col("user_id").alias("source"), F.col("event_id").alias("pos"), value.alias("value")))


LAST_RESULTS = """SELECT user_id AS source, '{"type":"result","id":' || max(event_id) FILTER (event_type = 'purchase') || '}' AS result, count(*) FILTER (event_type = 'click') AS retries FROM events GROUP BY user_id"""

# -- JSON, keys and fields -------------------------------------------------------------------------------------------


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines of canonical JSON, with blanks as artifacts have them and without; JSON with a repeated key is none."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("z"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("a"))
    lines = sinks.json_lines(n).select(F.col("value").alias("line"))
    return lines.select("line", canonical_json("line").alias("compact"), strict_json(F.concat(F.lit('{"x":1,'), F.substr("line", F.lit(2)))).alias("strict"), strict_json(F.concat(F.lit('{"z":1,'), F.substr("line", F.lit(2)))).alias("repeated"))


JSON_TEXTS = """WITH n AS (SELECT n_nationkey AS z, to_json(n_name)::VARCHAR AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE 'null' END AS a FROM nation)
SELECT '{"a": ' || a || ', "name": ' || name || ', "z": ' || z || '}' AS line, '{"a":' || a || ',"name":' || name || ',"z":' || z || '}' AS compact, '{"a":' || a || ',"name":' || name || ',"x":1,"z":' || z || '}' AS strict, NULL::VARCHAR AS repeated FROM n"""


def entry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names of parts: cache keys, joined keys, slugs, labels, row-set names, cohort ids."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" "), "p_name", F.lit("_/ "), F.col("p_size").cast("string"), F.lit(" \t"))
    return p.select(
        "p_partkey", T.entry_key(T.digest("p_name"), F.lit('{"a":1}')).alias("entry_key"), T.joined_key(F.col("p_name"), F.col("p_size").cast("string"), size=16).alias("joined"), T.slug(raw).alias("slug"), T.custody_label(raw).alias("label"),
        T.row_set_name(F.concat(F.lit("$."), raw)).alias("row_set"), ledger.cohort_id(F.col("p_name").alias("b"), F.col("p_brand").alias("a")).alias("cohort"),
    )


_RAW = "' ' || p_name || '_/ ' || p_size || ' ' || chr(9)"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ENTRY_KEYS = f"""SELECT p_partkey, sha256(p_name) || '-' || left(sha256('{{"a":1}}'), 16) AS entry_key, left(sha256(p_name || chr(10) || p_size), 16) AS joined, trim(regexp_replace({_LOW.format(_RAW)}, '[^a-z0-9]+', '-', 'g'), '-') AS slug,
replace(trim({_LOW.format(_RAW)}, ' ' || chr(9)), '_', '-') AS label, trim(regexp_replace('$.' || {_RAW}, '[^\\pL\\pN_]+', '_', 'g'), '_') AS row_set, left(sha256('{{"a":' || to_json(p_brand) || ',"b":' || to_json(p_name) || '}}'), 16) AS cohort FROM part"""


def toon_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a row encoding must quote, and ones it must not."""
    k = F.col("event_id") % 8
    odd = F.when(k == 0, "true").when(k == 1, "").when(k == 2, " x").when(k == 3, F.concat("props", F.lit('\t"'))).when(k == 4, F.concat("event_type", F.lit("\n\\"))).when(k == 5, None).when(k == 6, "Null").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", odd.alias("t"))
    return e.select("event_id", T.toon_field(F.col("t")).alias("field"), T.toon_field(F.col("event_id") % 2 == 0, "boolean").alias("flag"))


TOON_FIELDS = r"""WITH e AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '' WHEN 2 THEN ' x' WHEN 3 THEN props || chr(9) || '"' WHEN 4 THEN event_type || chr(10) || '\' WHEN 5 THEN NULL WHEN 6 THEN 'Null' ELSE event_type END AS t FROM events)
SELECT event_id, CASE WHEN event_id % 8 < 5 OR event_id % 8 = 6 THEN '"' || replace(replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"' ELSE coalesce(t, 'null') END AS field, (event_id % 2 = 0)::VARCHAR AS flag FROM e"""


def cached_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authenticated cache of nations' comments: hits, misses, and entries whose body was changed."""
    key = b"of the test only"
    n = table(spark, sf_dir, "nation").select(F.encode("n_name", "UTF-8").alias("raw"), F.lit("summary").alias("artifact"), F.concat(F.lit("body of "), "n_name").alias("body"), "n_nationkey")
    kept = sinks.cache_entries(n.where("n_nationkey % 3 > 0"), "raw", F.lit("{}"), key)
    spoilt = kept.withColumn("body", F.when(F.col("body").like("%A%"), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    wanted = n.select(T.entry_key(F.sha2("raw", 256), F.lit("{}")).alias("entry_key"), "artifact")
    return sinks.cached(wanted, spoilt, key)


CACHED_ARTIFACTS = """SELECT sha256(n_name) || '-' || left(sha256('{}'), 16) AS entry_key, 'summary' AS artifact, CASE WHEN n_nationkey % 3 = 0 THEN 'miss' WHEN contains(n_name, 'A') THEN 'quarantined' ELSE 'hit' END AS state, CASE WHEN n_nationkey % 3 > 0 AND NOT contains(n_name, 'A') THEN 'body of ' || n_name END AS body FROM nation"""


def quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as dimensions of quality cases; a label that is not there does not apply."""
    rows = table(spark, sf_dir, "labels").select(F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), passed.alias("passed")) for name, passed in (("quality", F.col("quality") == 1), ("harmless", F.col("toxic") == 0), ("even", F.when(F.col("doc_id") % 2 == 0, F.lit(True))))]))).select("col.*")
    return rules.dimension_rollup(rows)


QUALITY_DIMENSIONS = """WITH d AS (SELECT 'quality' AS dimension, quality = 1 AS passed FROM labels UNION ALL SELECT 'harmless', toxic = 0 FROM labels UNION ALL SELECT 'even', CASE WHEN doc_id % 2 = 0 THEN TRUE END FROM labels)
SELECT dimension, count(passed) AS applicable, count(*) FILTER (passed) AS passed_cases, coalesce(bool_and(passed), TRUE) AS ok FROM d GROUP BY dimension"""


def model_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders by the keyed hash of the customer, of which the first 32 to appear are told apart; the hashes
    themselves, which SQL has no function for, are left out."""
    o = table(spark, sf_dir, "orders").withColumn("model", hmac_hex(F.col("o_custkey").cast("string"), b"of the test only", 16))
    return chatlog.bounded_counter(o, "model", ["o_orderkey"]).select((F.col("bucket") == "__other__").alias("other"), F.length("bucket").alias("size"), "n")


MODEL_BUCKETS = """WITH u AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY min(o_orderkey)) AS k FROM orders GROUP BY o_custkey)
SELECT k > 32 AS other, CASE WHEN k > 32 THEN 9 ELSE 16 END AS size, sum(n)::BIGINT AS n FROM u GROUP BY k > 32, CASE WHEN k > 32 THEN 0 ELSE k END"""

# -- queues ----------------------------------------------------------------------------------------------------------


def queued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as prompts, some with a secret put in: a job for each conversation, out of its last turn."""
    t = table(spark, sf_dir, "conversations")
    secret = F.when(F.col("turn") % 2 == 0, F.lit(" mail me@example.org ignore previous instructions https://x.org")).otherwise("")
    prompts = t.select(F.concat(F.lit("job-"), F.col("conv_id").cast("string")).alias("id"), F.format_string("%06d", "turn").alias("created_at"), F.lit("none").alias("tool"), F.concat(F.coalesce("text", F.lit("")), secret).alias("prompt"))
    jobs = appends.queued(spread(prompts))
    return jobs.select("id", "created_at", "tool", "authorization", T.digest("prompt").alias("sha256"), F.array_join("redactions", ",").alias("redactions"), F.array_join("flags", ",").alias("flags"))


QUEUED_JOBS = f"""WITH p AS (SELECT conv_id * 1000000 + turn AS k, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' mail me@example.org ignore previous instructions https://x.org' ELSE '' END AS text FROM conversations),
q AS (SELECT arg_max(k, k) AS k, arg_max(text, k) AS text FROM p GROUP BY k // 1000000), {sql_redacted('q', 'k', 'text')},
f AS (SELECT k, t, {FINDINGS} AS findings FROM r9)
SELECT 'job-' || k // 1000000 AS id, printf('%06d', k % 1000000) AS created_at, 'none' AS tool, 'queued-not-authorized' AS "authorization", sha256(t) AS sha256, findings AS redactions,
concat_ws(',', CASE WHEN findings <> '' THEN 'redacted' END, CASE WHEN regexp_matches(t, '{SQL_INJECTION}') THEN 'injection-shaped' END, CASE WHEN regexp_matches(t, '{SQL_URL}') THEN 'has-url' END) AS flags FROM f"""

_ALL = (queued_jobs, answer_telemetry, chunked_answers, framed_responses, request_documents, log_grammar, usage_checks, usage_comparison, response_sources, agent_logs, last_results, json_texts, entry_keys, toon_fields, cached_artifacts, quality_dimensions, model_buckets)

QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {name: sql for name in QUERIES if (sql := globals().get(name.upper()))}
