"""Queries of usage artifacts and sidecars, and the SQL that evaluates the same rules in its own way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.operators import sidecar
from sedge.operators.usage import FIELDS
from sedge.plans.registry import table

# -- streams kept as artifacts ---------------------------------------------------------------------------------------

#: What is done to the stream of a user, by the user's number modulo 16: (what stands there, what is put for it).
_SPOILT = {
    1: ('"status":"completed"', '"status":"incomplete"'), 2: ("event: made", "event: made\nevent: made"), 3: ("data: {}\n\nevent: made", "\n\nevent: made"), 4: ("\n\n: end", "\n\n: end\nretry: 3"), 5: ("\n\n: end", "\n\nevent: late\ndata: {}\n\n: end"), 6: ('{"type":"response.completed"', '{"type":"response.done"'), 7: ("\n\n: end", "\n: end"), 8: ('"input_tokens":', '"input_tokens":0.5,"x":'), 9: ("data: {}\n", "data: [1]\n"), 10: ('"type":"response.completed"', '"type":[1]'), 11: ("response.completed", "response.failed"), 12: ('"model":"m-1"', '"model":"a b"'), 13: ('"object":"response"', '"object":"thread"'), 14: ('"total_tokens":', '"total_tokens":1'),
}
_EVENTS = "event: made\ndata: {}\n\nevent: made\ndata:  {\"type\":\ndata: \"made\"}\n\n"
_END = 'event: response.completed\ndata: {"type":"response.completed","response":{"object":"response","model":"m-1","status":"completed","usage":{"input_tokens":@I@,"output_tokens":@O@,"total_tokens":@T@}}}\n\n: end'


def stream_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each user: an event for each of its clicks, then a completion that counts views and purchases; most are
    spoilt in one way."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "view").alias("i"), F.count_if(F.col("event_type") == "purchase").alias("o"))
    whole = F.concat(F.repeat(F.lit(_EVENTS), F.col("c").cast("int") + 1), F.lit(_END))
    for mark, n in (("@I@", F.col("i")), ("@O@", F.col("o")), ("@T@", F.col("i") + F.col("o"))):
        whole = F.replace(whole, F.lit(mark), n.cast("string"))
    e = e.withColumn("whole", whole)
    text = F.col("whole")
    for k, (old, new) in _SPOILT.items():
        text = F.when(F.col("user_id") % 16 == k, F.replace("whole", F.lit(old), F.lit(new))).otherwise(text)
    return sidecar.stream_usage(e.select(F.col("user_id").alias("key"), text.alias("text"))).select("key", "error", "model", "input_tokens", "output_tokens", "total_tokens")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_REPLACED = "replace(replace(replace(repeat(" + _quoted(_EVENTS) + ", c::INTEGER + 1) || " + _quoted(_END) + ", '@I@', i::VARCHAR), '@O@', o::VARCHAR), '@T@', (i + o)::VARCHAR)"
STREAM_ARTIFACTS = rf"""WITH e AS (SELECT user_id AS key, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS i, count(*) FILTER (event_type = 'purchase') AS o FROM events GROUP BY user_id),
b AS (SELECT key, {_REPLACED} AS t FROM e),
d AS (SELECT key, CASE key % 16 {' '.join(f"WHEN {k} THEN replace(t, {_quoted(old)}, {_quoted(new)})" for k, (old, new) in _SPOILT.items())} ELSE t END AS t FROM b),
l AS (SELECT key, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
g AS (SELECT *, count(*) FILTER (line = '') OVER (PARTITION BY key ORDER BY pos) - CASE WHEN line = '' THEN 1 ELSE 0 END AS grp FROM l),
h AS (SELECT key, grp, count(*) FILTER (starts_with(line, 'event:')) AS names, count(*) FILTER (starts_with(line, 'data:')) AS datas, count(*) FILTER (line <> '' AND NOT starts_with(line, ':') AND NOT starts_with(line, 'event:') AND NOT starts_with(line, 'data:')) AS others, bool_or(line = '') AS ended,
    max(ltrim(line[7:], ' ')) FILTER (starts_with(line, 'event:')) AS name, string_agg(ltrim(line[6:], ' '), chr(10) ORDER BY pos) FILTER (starts_with(line, 'data:')) AS data FROM g GROUP BY key, grp),
v AS (SELECT *, CASE WHEN json_valid(data) THEN data::JSON END AS j FROM h WHERE names + datas > 0),
w AS (SELECT *, CASE WHEN json_type(j, '$.type') = 'VARCHAR' THEN j->>'$.type' END AS kind FROM v),
x AS (SELECT *, coalesce(name IN ('response.completed', 'response.failed', 'response.incomplete', 'error'), FALSE) OR coalesce(kind IN ('response.completed', 'response.failed', 'response.incomplete', 'error'), FALSE) AS ends FROM w),
y AS (SELECT key, bool_or(names > 1) AS twice, bool_or(names = 1 AND datas = 0 AND ended) AS bare, bool_or(NOT ended) AS cut, bool_or(coalesce(json_type(j), '') <> 'OBJECT') AS nojson, bool_or(coalesce(json_type(j, '$.type') NOT IN ('VARCHAR', 'NULL'), FALSE)) AS oddtype, bool_or(ends AND name IS DISTINCT FROM kind) AS oddname, bool_or(ends AND kind IS DISTINCT FROM 'response.completed') AS failed, min(grp) FILTER (ends) AS stop, max(grp) AS last, arg_min(j->'$.response', grp) FILTER (ends) AS r FROM x GROUP BY key),
o AS (SELECT key, bool_or(others > 0) AS field FROM h GROUP BY key),
z AS (SELECT key, r->>'$.model' AS model, CASE WHEN json_type(r, '$.usage.input_tokens') = 'UBIGINT' THEN (r->>'$.usage.input_tokens')::BIGINT END AS i, (r->>'$.usage.output_tokens')::BIGINT AS o, (r->>'$.usage.total_tokens')::BIGINT AS t,
  CASE WHEN field THEN 'field' WHEN twice THEN 'repeated-name' WHEN bare THEN 'no-data' WHEN cut THEN 'unterminated' WHEN nojson THEN 'not-json' WHEN oddtype THEN 'type' WHEN oddname THEN 'name' WHEN failed THEN 'not-completed' WHEN last > stop THEN 'after-completion' WHEN stop IS NULL THEN 'no-completion'
    WHEN r->>'$.object' <> 'response' THEN 'not-a-response' WHEN r->>'$.status' <> 'completed' THEN 'not-completed' WHEN NOT regexp_full_match(r->>'$.model', '{sidecar.LABEL}') THEN 'model' WHEN json_type(r, '$.usage.input_tokens') <> 'UBIGINT' THEN 'count' END AS error FROM y JOIN o USING (key)),
f AS (SELECT *, coalesce(error, CASE WHEN t < i THEN 'total-covers-input' WHEN t <> i + o THEN 'total-is-sum' END) AS fault FROM z)
SELECT key, fault AS error, CASE WHEN fault IS NULL THEN model END AS model, CASE WHEN fault IS NULL THEN i END AS input_tokens, CASE WHEN fault IS NULL THEN o END AS output_tokens, CASE WHEN fault IS NULL THEN t END AS total_tokens FROM f"""

# -- whole sidecars of conversations ---------------------------------------------------------------------------------

_USAGES = (
    '{"object":"response","model":"m-1","status":"completed","usage":{"input_tokens":@N@,"output_tokens":2}}',
    'event: response.completed\ndata: {"type":"response.completed","response":{"object":"response","model":"m-1","status":"completed","usage":{"input_tokens":@N@,"input_tokens_details":{"cached_tokens":1}}}}\n\n',
    '{"object":"response.input_tokens","input_tokens":@N@}',
    '{"type":"item.completed","item":{"type":"agent_message","text":"done"}}\n{"type":"turn.completed","usage":{"input_tokens":@N@,"cache_write_tokens":1}}',
)
_REQUEST = '{"model":"m-1","input":"@N@"}'


def _case_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as cases: the source by the number modulo 4, the hand-off by its quarter modulo 4; turns are requests (of
    agents all, of others the first), the texts of two first turns artifacts. By the number modulo 23: 1 a changed manifest,
    2 no summary, 3 an unlisted one, 4 a request that is a list, 5 one without a model, 6 no usage, 7 a negative count, 8 a
    label of another model, 9 all requests where one may be."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    c, k = F.col("conv_id"), F.col("conv_id") % 23
    cases = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        c.cast("string").alias("case_id"), "conv_id", "n", F.element_at(F.array(*map(F.lit, sidecar.SOURCES)), (c % 4 + 1).cast("int")).alias("source"), F.element_at(F.array(*map(F.lit, sidecar.HANDOFFS)), (F.floor(c / 4) % 4 + 1).cast("int")).alias("variant"),
        F.when(k == 8, "m-2").when(c % 4 == 3, "m-1").alias("model_label"), *[F.sha2(F.concat(F.lit(x), c.cast("string")), 256).alias(f"{name}_sha256") for x, name in (("l", "ledger"), ("o", "corpus_ordered"), ("d", "corpus_diversity"))],
    )
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("at")) for n, t in (("summary.md", 0), ("source-cards.jsonl", 1), ("source-cards.toon", 1))])
    held = turns.where("turn < 2").select("conv_id", "turn", "text").join(cases.select("conv_id"), "conv_id").select("conv_id", "text", "turn", F.explode(names).alias("x")).where("x.at = turn").select("conv_id", F.col("x.name").alias("name"), F.encode("text", "utf-8").alias("content"))
    held = held.unionByName(cases.select("conv_id", F.lit("manifest.json").alias("name"), F.encode(F.concat(F.lit("manifest "), "case_id"), "utf-8").alias("content")))
    entries = sidecar.described(held).where((k != 3) | (F.col("name") != "summary.md")).select(c.cast("string").alias("case_id"), "name", "bytes", "sha256")
    artifacts = held.where((k != 2) | (F.col("name") != "summary.md")).select("conv_id", F.lit("artifact").alias("role"), "name", F.lit(0).alias("ordinal"), F.when((k == 1) & (F.col("name") == "manifest.json"), F.encode(F.lit("changed"), "utf-8")).otherwise(F.col("content")).alias("content"))
    request = F.when(k == 4, "[1]").when(k == 5, "{}").otherwise(F.replace(F.lit(_REQUEST), F.lit("@N@"), F.col("turn").cast("string")))
    requests = turns.where((c % 4 == 3) | (F.col("turn") == 0) | (k == 9)).select("conv_id", F.lit("request").alias("role"), F.lit("r").alias("name"), F.col("turn").cast("int").alias("ordinal"), F.encode(request, "utf-8").alias("content"))
    usage = F.replace(F.element_at(F.array(*map(F.lit, _USAGES)), (c % 4 + 1).cast("int")), F.lit("@N@"), F.when(k == 7, "-1").otherwise(F.col("n").cast("string")))
    used = cases.where(k != 6).select("conv_id", F.lit("usage").alias("role"), F.lit("u").alias("name"), F.lit(0).alias("ordinal"), F.encode(usage, "utf-8").alias("content"))
    files = artifacts.unionByName(requests).unionByName(used).select(c.cast("string").alias("case_id"), "role", "name", "ordinal", "content")
    return cases.drop("conv_id", "n"), entries, files


def built_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sidecar.built(*_case_tables(spark, sf_dir))
    return made.select("case_id", "error", "sidecar")


_SQL_CASES = f"""n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id % 23 AS k, conv_id % 4 AS s, ({list(sidecar.SOURCES)!r})[conv_id % 4 + 1] AS source, ({list(sidecar.HANDOFFS)!r})[conv_id // 4 % 4 + 1] AS variant, CASE WHEN conv_id % 23 = 8 THEN 'm-2' WHEN conv_id % 4 = 3 THEN 'm-1' END AS label,
  replace(CASE conv_id % 4 {' '.join(f'WHEN {i} THEN {_quoted(u)}' for i, u in enumerate(_USAGES))} END, '@N@', CASE WHEN conv_id % 23 = 7 THEN '-1' ELSE n::VARCHAR END) AS usage FROM n),
t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
h AS (SELECT conv_id, 'summary.md' AS name, 1 AS place, text AS body FROM t WHERE turn = 0 UNION ALL SELECT conv_id, 'source-cards.jsonl', 2, text FROM t WHERE turn = 1 UNION ALL SELECT conv_id, 'source-cards.toon', 2, text FROM t WHERE turn = 1 UNION ALL SELECT conv_id, 'manifest.json', 0, 'manifest ' || conv_id FROM n),
w AS (SELECT conv_id, unnest(['manifest.json'] || CASE variant {' '.join(f"WHEN '{v}' THEN {names!r}::VARCHAR[]" for v, names in sidecar.HANDOFFS.items())} END) AS name FROM c),
m AS (SELECT w.conv_id, w.name, place, h.body, CASE WHEN k = 1 AND w.name = 'manifest.json' THEN 'changed' ELSE h.body END AS found, k = 2 AND w.name = 'summary.md' AS lost, k = 3 AND w.name = 'summary.md' AS unlisted FROM w JOIN c USING (conv_id) LEFT JOIN h ON h.conv_id = w.conv_id AND h.name = w.name),
a AS (SELECT conv_id, bool_or(lost OR body IS NULL) AS missing, bool_or(unlisted AND body IS NOT NULL) AS surplus, bool_or(found <> body) AS changed, '[' || coalesce(string_agg('{{"name":"' || name || '","bytes":' || octet_length(encode(found)) || ',"sha256":"' || sha256(found) || '"}}', ',' ORDER BY place) FILTER (place > 0), '') || ']' AS handoff,
  max('{{"bytes":' || octet_length(encode(found)) || ',"sha256":"' || sha256(found) || '"}}') FILTER (place = 0) AS manifest FROM m GROUP BY conv_id),
q AS (SELECT t.conv_id, turn, CASE k WHEN 4 THEN '[1]' WHEN 5 THEN '{{}}' ELSE replace('{_REQUEST}', '@N@', turn::VARCHAR) END AS body FROM t JOIN c USING (conv_id) WHERE s = 3 OR turn = 0 OR k = 9),
r AS (SELECT conv_id, count(*) AS requests, bool_or(json_type(body::JSON) <> 'OBJECT') AS odd, bool_or(coalesce(NOT regexp_full_match(body::JSON->>'$.model', '{sidecar.LABEL}'), TRUE)) AS unnamed, '[' || string_agg('{{"bytes":' || octet_length(encode(body)) || ',"sha256":"' || sha256(body) || '"}}', ',' ORDER BY turn) || ']' AS ordered FROM q GROUP BY conv_id),
u AS (SELECT conv_id, CASE s WHEN 1 THEN regexp_extract(usage, 'data: (.*)', 1) WHEN 3 THEN regexp_extract(usage, '(.*turn.completed.*)', 1) ELSE usage END::JSON AS j FROM c),
p AS (SELECT conv_id, CASE s WHEN 0 THEN j->'$.usage' WHEN 1 THEN j->'$.response.usage' WHEN 2 THEN j ELSE j->'$.usage' END AS g FROM u JOIN c USING (conv_id)),
x AS (SELECT conv_id, (g->>'$.input_tokens')::BIGINT AS input_tokens, (g->>'$.input_tokens_details.cached_tokens')::BIGINT AS cached_input_tokens, (g->>'$.cache_write_tokens')::BIGINT AS cache_write_tokens, (g->>'$.output_tokens')::BIGINT AS output_tokens, NULL::BIGINT AS reasoning_output_tokens, NULL::BIGINT AS total_tokens FROM p),
f AS (SELECT *, coalesce(CASE WHEN requests IS NULL THEN 'no-request' WHEN s <> 3 AND requests <> 1 THEN 'one-request' WHEN requests > {sidecar.MAX_REQUESTS} THEN 'requests' WHEN missing THEN 'artifact-missing' WHEN surplus THEN 'artifact-unlisted' WHEN changed THEN 'artifact-changed' WHEN odd THEN 'request-json' WHEN unnamed THEN 'request-model' WHEN k = 6 THEN 'no-usage-artifact' END,
  'usage-' || CASE WHEN input_tokens < 0 THEN 'count' WHEN cached_input_tokens > input_tokens THEN 'cached-within-input' WHEN cache_write_tokens > input_tokens THEN 'written-within-input' WHEN output_tokens IS NOT NULL AND FALSE THEN '' END, CASE WHEN label <> 'm-1' THEN 'model-label' END) AS error FROM c JOIN a USING (conv_id) LEFT JOIN r USING (conv_id) JOIN x USING (conv_id))"""
_CLAIMS = ",".join(f'"{k}":{v}' if isinstance(v, int) else f'"{k}":"{v}"' for k, v in sidecar.CLAIMS.items())
BUILT_SIDECARS = f"""WITH {_SQL_CASES}
SELECT conv_id::VARCHAR AS case_id, error, CASE WHEN error IS NULL THEN '{{"schema_version":1,"kind":"{sidecar.KIND}","claims":{{{_CLAIMS}}},"ledger":{{"sha256":"' || sha256('l' || conv_id) || '","corpus_ordered_sha256":"' || sha256('o' || conv_id) || '","corpus_diversity_sha256":"' || sha256('d' || conv_id) || '"}},"variant":"' || variant || '","source":"' || source || '","handoff_artifacts":' || handoff || ',"manifest":' || manifest
  || ',"usage_artifact":{{"bytes":' || octet_length(encode(usage)) || ',"sha256":"' || sha256(usage) || '"}},"requests":{{"ordered":' || ordered || ',"sequence_sha256":"' || sha256(ordered) || '"}},"model":{{"label":"m-1","provenance":"' || CASE WHEN s < 2 THEN 'response_returned' ELSE 'request_declared' END || '"}},"usage":{{'
  || {" || ',' || ".join(f"'\"{x}\":' || coalesce({x}::VARCHAR, 'null')" for x in FIELDS)} || ',"omitted_fields":[' || concat_ws(',', {', '.join(f"CASE WHEN {x} IS NULL THEN '\"{x}\"' END" for x in FIELDS)}) || ']}}}}' END AS sidecar FROM f"""

#: What is done to the sidecar of a conversation, by its number modulo 29: (what stands there, what is put for it).
_CHANGED = {
    0: ('"schema_version":1', '"schema_version":"1"'), 1: ('"schema_version":1', '"schema_version":2'), 2: ('"kind":', '"king":'), 3: ('"cost":"none"', '"cost":"low"'), 4: ('"requests_made":0', '"requests_made":3'), 5: ('"ledger":{', '"ledger":{"x":{"y":1},'), 6: ('"corpus_ordered_sha256":"', '"corpus_ordered_sha256":"A'), 7: ('"source":"', '"source":"x-'), 8: ('"variant":"', '"variant":"x-'), 9: ('"manifest":{"bytes":', '"manifest":{"bytes":-'),
    10: ('"usage_artifact":{', '"usage_artifact":{"name":"u",'), 11: ('"label":"m-1"', '"label":"m 1"'), 12: ('"provenance":"re', '"provenance":"x-re'), 13: ('"input_tokens":', '"input_tokens":null,"x":'), 14: ('"output_tokens":', '"output_tokens":"2","y":'), 15: ('"omitted_fields":[', '"omitted_fields":["model",'), 16: ('"sequence_sha256":"', '"sequence_sha256":"0'), 17: ('"ordered":[{"bytes":', '"ordered":[{"bytes":1'), 18: ('"variant":"summary_only"', '"variant":"raw_input"'), 19: ('"provenance":"request_declared"', '"provenance":"response_returned"'), 20: ('"reasoning_output_tokens":null', '"reasoning_output_tokens":99'), 21: ('"total_tokens":null', '"total_tokens":0'), 22: ('"cache_write_tokens":null', '"cache_write_tokens":999999'), 23: ('"ordered":[{', '"ordered":[3,{'), 24: ("}}", "}"),
}


def sidecar_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecars of conversations, most of them changed in one place: what is wrong with each."""
    made = sidecar.built(*_case_tables(spark, sf_dir)).where("sidecar is not null").select("case_id", F.col("sidecar").alias("json"))
    text, k = F.col("json"), F.col("case_id").cast("long") % 29
    for n, (old, new) in _CHANGED.items():
        text = F.when(k == n, F.replace(F.col("json"), F.lit(old), F.lit(new))).otherwise(text)
    return sidecar.validated(made.select("case_id", text.alias("json")), "case_id").select("case_id", F.array_join("errors", ",").alias("errors"))


def _sql_schema() -> str:
    rows = []
    for f in sidecar.SCHEMA:
        parent, _, name = f.path.rpartition(".")
        rows.append(f"('{f.path}', {'NULL' if f.path == '$' or f.path.endswith('[]') else repr(parent)}, '{name}', '{f.kinds}', {'NULL' if f.least is None else f.least}::HUGEINT, {'NULL' if f.most is None else f.most}::HUGEINT, {'NULL' if f.pattern is None else repr(f.pattern)})")
    return ", ".join(rows)


def _get(path: str) -> str:
    return f"(j->>'$.{path}')"


SIDECAR_ERRORS = rf"""WITH made AS ({BUILT_SIDECARS}),
d AS (SELECT case_id, CASE case_id::BIGINT % 29 {' '.join(f"WHEN {k} THEN replace(sidecar, {_quoted(old)}, {_quoted(new)})" for k, (old, new) in _CHANGED.items())} ELSE sidecar END AS json FROM made WHERE sidecar IS NOT NULL),
schema AS (SELECT * FROM (VALUES {_sql_schema()}) AS s(path, parent, name, kinds, least, most, pattern)),
v AS (SELECT case_id, json::JSON AS j FROM d WHERE json_valid(json)),
n AS (SELECT case_id, fullkey AS spot, regexp_replace(fullkey, '\[[0-9]+\]', '[]', 'g') AS path, key, id, parent, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE lower(type) END AS kind, atom->>'$' AS atom, CASE type WHEN 'ARRAY' THEN json_array_length(value) END AS size FROM v, json_tree(j)),
k AS (SELECT n.*, s.path IS NOT NULL AS known, list_contains(string_split(s.kinds, '|'), n.kind) AS fits, s.least, s.most, s.pattern FROM n LEFT JOIN schema s ON s.path = n.path),
e AS (SELECT case_id, 'kind:' || spot AS error FROM k WHERE known AND NOT fits
  UNION ALL SELECT case_id, 'range:' || spot FROM k WHERE known AND fits AND kind IN ('integer', 'array') AND NOT (coalesce(CASE kind WHEN 'array' THEN size ELSE atom::HUGEINT END >= least, TRUE) AND coalesce(CASE kind WHEN 'array' THEN size ELSE atom::HUGEINT END <= most, TRUE))
  UNION ALL SELECT case_id, 'value:' || spot FROM k WHERE known AND fits AND kind = 'string' AND pattern IS NOT NULL AND NOT regexp_full_match(atom, pattern)
  UNION ALL SELECT k.case_id, 'unknown:' || k.spot FROM k JOIN k o ON o.case_id = k.case_id AND o.id = k.parent WHERE NOT k.known AND o.known AND o.fits AND o.kind = 'object'
  UNION ALL SELECT o.case_id, 'missing:' || o.spot || '.' || s.name FROM k o JOIN schema s ON s.parent = o.path WHERE o.known AND o.fits AND o.kind = 'object' AND NOT EXISTS (FROM n c WHERE c.case_id = o.case_id AND c.parent = o.id AND c.key = s.name)),
u AS (SELECT case_id, j, {', '.join(f"{_get('usage.' + f)}::BIGINT AS {f}" for f in FIELDS)}, {_get('source')} AS source, {_get('variant')} AS variant, {_get('model.provenance')} AS provenance FROM v WHERE case_id NOT IN (SELECT case_id FROM e)),
r AS (SELECT case_id, unnest([
    CASE WHEN json_extract_string(j, '$.handoff_artifacts[*].name') <> CASE variant {' '.join(f"WHEN '{v}' THEN {names!r}::VARCHAR[]" for v, names in sidecar.HANDOFFS.items())} END THEN 'artifacts-of-variant' END, CASE WHEN source <> 'codex-jsonl' AND json_array_length(j, '$.requests.ordered') <> 1 THEN 'one-request' END,
    CASE WHEN {_get('requests.sequence_sha256')} <> sha256('[' || array_to_string(list_transform(json_extract(j, '$.requests.ordered[*]'), lambda x: '{{"bytes":' || (x->>'$.bytes') || ',"sha256":"' || (x->>'$.sha256') || '"}}'), ',') || ']') THEN 'request-sequence' END,
    CASE WHEN provenance <> CASE WHEN source IN ('responses-json', 'responses-sse') THEN 'response_returned' ELSE 'request_declared' END THEN 'provenance-of-source' END,
    CASE WHEN json_extract_string(j, '$.usage.omitted_fields[*]') <> list_filter([{', '.join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in FIELDS)}], lambda x: x IS NOT NULL) THEN 'omitted-are-null' END, CASE WHEN source = 'responses-input-count' AND coalesce({', '.join(FIELDS[1:])}) IS NOT NULL THEN 'count-has-input-only' END,
    CASE WHEN cached_input_tokens > input_tokens THEN 'cached-within-input' END, CASE WHEN cache_write_tokens > input_tokens THEN 'written-within-input' END, CASE WHEN reasoning_output_tokens > output_tokens THEN 'reasoning-within-output' END, CASE WHEN total_tokens < input_tokens THEN 'total-covers-input' END, CASE WHEN total_tokens <> input_tokens + output_tokens THEN 'total-is-sum' END]) AS error FROM u),
a AS (SELECT case_id, 'not-json' AS error FROM d WHERE NOT json_valid(json) UNION ALL FROM e UNION ALL SELECT * FROM r WHERE error IS NOT NULL)
SELECT case_id, coalesce(string_agg(DISTINCT error, ',' ORDER BY error), '') AS errors FROM d LEFT JOIN a USING (case_id) GROUP BY case_id"""

_ALL = (stream_artifacts, built_sidecars, sidecar_errors)

QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {name: sql for name in QUERIES if (sql := globals().get(name.upper()))}
