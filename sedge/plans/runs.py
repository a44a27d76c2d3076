"""Queries of whole runs: summaries, manifests, formats, the hook, bindings of claims; and the SQL that says the same."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.spread import cut
from sedge.operators import analyze, eventlog, render, rules
from sedge.operators import cards as C
from sedge.plans import condense
from sedge.plans.registry import RUN, SQL_CARDS, SQL_CRITICAL, SQL_FLAGS, SQL_QUESTION, SQL_RUN, SQL_TOKENS, SQL_URL, _cards, _inputs, documents, table

# -- claims made harmless --------------------------------------------------------------------------------------------


def sql_defanged(c: str) -> str:
    c = rf"regexp_replace(regexp_replace({c}, '!\[\]\([^)]+\)', '[defanged-image: unnamed]', 'g'), '!\[([^\]]+)\]\([^)]+\)', '[defanged-image: \1]', 'g')"
    c = rf"regexp_replace({c}, '\[([^\]]*)\]\([^)]+\)', '\1 [defanged-link]', 'g')"
    for scheme in ("javascript", "vbscript", "data"):
        c = rf"regexp_replace({c}, '(?i)\b{scheme}:', '{scheme}-defanged:', 'g')"
    return f"replace(replace({c}, 'https://', 'hxxps://'), 'http://', 'hxxp://')"


def sql_span(c: str) -> str:
    fence = f"repeat('`', coalesce(list_max(list_transform(regexp_extract_all({c}, '`+'), lambda x: length(x))), 0) + 1)"
    return f"{fence} || ' ' || {sql_defanged(c)} || ' ' || {fence}"


def defanged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text with links, images and schemes of every kind put in, made harmless."""
    raw = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("![x]("), "url", F.lit(") [a]("), "url", F.lit(") ![]("), "url", F.lit(") ``run`` JavaScript:go data:x "), F.coalesce("html", F.lit(""))).alias("t"))
    return raw.select("page_id", T.defang_claim(F.col("t")).alias("claim"), T.defang(F.col("t")).alias("plain"), T.claim_span(F.col("t")).alias("span"))


_T = "'![x](' || url || ') [a](' || url || ') ![](' || url || ') ``run`` JavaScript:go data:x ' || coalesce(html, '')"
DEFANGED_LINES = f"SELECT page_id, {sql_defanged('t')} AS claim, replace({sql_defanged('t')}, '`', '''') AS plain, {sql_span('t')} AS span FROM (SELECT page_id, {_T} AS t FROM pages)"

# -- summaries -------------------------------------------------------------------------------------------------------


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.summary(*render.numbered(_cards(spark, sf_dir), _inputs(spark, sf_dir)))


def sql_summary(run: str, inputs: str, cards: str = "cards") -> str:
    """CTEs up to ``summed`` (run_id, summary) after SQL_CARDS; ``inputs``: run_id, doc_id, name, sha, tier."""
    quote = lambda x: x.replace("'", "''")
    part = lambda n, where: f"string_agg(line, chr(10) ORDER BY ord) FILTER (section = {n}{where})"
    section = lambda n, title: f"|| chr(10) || chr(10) || '{title}' || chr(10) || coalesce({part(n, '')}, '{render.NONE}')"
    return f""", i AS ({inputs}),
ii AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY doc_id) AS ordinal FROM i),
ia AS (SELECT *, min(ordinal) OVER (PARTITION BY run_id, name, sha) AS alias, count(DISTINCT tier) OVER (PARTITION BY run_id) > 1 AS mixed FROM ii),
sc AS (SELECT ia.run_id, doc_id, alias, tier, claim, rank, line_start, line_end, {SQL_FLAGS.replace("concat_ws(',',", "concat_ws(' ',")} AS flags, row_number() OVER (PARTITION BY ia.run_id ORDER BY doc_id, rank) AS ord FROM {cards} JOIN ia USING (doc_id)),
sr AS (SELECT *, printf('c%d@s%d/src-%03d', ord, alias, rank) AS ref, regexp_matches(claim, '{SQL_CRITICAL}') AS a, regexp_matches(claim, '{SQL_QUESTION}') AS b FROM sc),
sm AS (SELECT *, '- ' || ref || ' [' || tier || ']' || CASE WHEN flags <> '' THEN ' [' || flags || ']' ELSE '' END AS mark FROM sr),
sl AS (SELECT run_id, 0 AS section, ordinal AS ord, printf('- s%d [%s] sha256=%s', ordinal, tier, sha) AS line FROM ia
  UNION ALL SELECT run_id, 1, ord, printf('- %s L%d-%d: ', ref, line_start, line_end) || {sql_span('claim')} FROM sm
  UNION ALL SELECT run_id, 2, ord, mark FROM sm WHERE a UNION ALL SELECT run_id, 3, ord, mark FROM sm WHERE b UNION ALL SELECT run_id, 4, ord, mark FROM sm WHERE NOT a AND NOT b),
summed AS (SELECT run_id, '# Condensation ' || run_id || chr(10) || chr(10) || '- Inputs: ' || count(*) FILTER (section = 0) || chr(10) || '- Claims: ' || count(*) FILTER (section = 1) || chr(10) || '- Format: {render.FORMAT}' || chr(10) || '{quote(render.QUOTED)}'
  || CASE WHEN (SELECT bool_or(mixed) FROM ia WHERE ia.run_id = sl.run_id) THEN chr(10) || '{quote(render.MIXED)}' ELSE '' END
  || chr(10) || chr(10) || '## Sources' || chr(10) || {part(0, '')} || chr(10) || chr(10) || '## Claims' || coalesce(chr(10) || {part(1, '')}, '')
  {section(2, '## Critical Constraints')} {section(3, '## Open Questions')} {section(4, '## Findings')}
  || chr(10) || chr(10) || '## Reopen' || chr(10) || '{(quote("@").join(map(quote, render.REOPEN))).replace("@", "' || chr(10) || '")}' || chr(10) AS summary FROM sl GROUP BY run_id)"""


SQL_INPUTS = f"SELECT {SQL_RUN} AS run_id, doc_id, source AS name, sha256(text) AS sha, coalesce(lang, 'untrusted') AS tier FROM documents"
SUMMARY_TEXT = SQL_CARDS + sql_summary(SQL_RUN, SQL_INPUTS) + " SELECT run_id, summary FROM summed"


_OVER = [(1, "src0", "a"), (2, "src1", "b"), (3, "src1", "c")]
_SETTINGS = {"max_cards_per_input": 24, "store_raw": False}
_MADE = "2026-01-01T00:00:00Z"


def _runs(spark: SparkSession, sf_dir: str) -> condense.Run:
    """Runs of 64 neighbouring documents' bytes, some over a cap on size, with tiers by path."""
    docs = documents(spark, sf_dir).select(F.expr(RUN).alias("run_id"), F.format_string("%s/%02d", "source", "doc_id").alias("source"), F.encode("text", "UTF-8").alias("content"))
    return condense.condense(docs, None, overrides=spark.createDataFrame(_OVER, "position int, path string, trust_tier string"), max_bytes=3000)


def condensed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's manifest row and summary together."""
    run = _runs(spark, sf_dir)
    inputs = F.array_join(F.transform("inputs", lambda x: F.concat_ws("|", x.source, x.sha256, x.bytes.cast("string"), x.trust_tier, x.withheld.cast("string"))), "\n")
    return run.manifest.withColumn("inputs", inputs).join(run.summary, "run_id")


_SQL_RUNS = (
    SQL_CARDS.replace("FROM documents", "FROM few", 1).replace("WITH ", """WITH few AS (SELECT doc_id, text FROM documents WHERE octet_length(encode(text)) <= 3000), """, 1)
    + sql_summary(SQL_RUN, f"""SELECT run_id, doc_id, name, sha, tier, bytes, row_number() OVER (PARTITION BY run_id ORDER BY name) AS place FROM (SELECT {SQL_RUN} AS run_id, doc_id, printf('%s/%02d', source, doc_id) AS name, sha256(text) AS sha, octet_length(encode(text)) AS bytes, CASE source WHEN 'src0' THEN 'a' WHEN 'src1' THEN 'c' ELSE 'untrusted' END AS tier FROM documents)""").replace("ORDER BY doc_id) AS ordinal", "ORDER BY name) AS ordinal").replace("ORDER BY doc_id, rank) AS ord", "ORDER BY ordinal, rank) AS ord")
)
CONDENSED_RUN = (
    _SQL_RUNS
    + """, x AS (SELECT *, bytes > 3000 AS held FROM ia), xc AS (SELECT run_id, count(*) AS cards FROM sc GROUP BY run_id)
SELECT run_id, string_agg(concat_ws('|', name, sha, bytes::VARCHAR, tier, held::VARCHAR), chr(10) ORDER BY name) AS inputs, count(*) AS documents, count(*) FILTER (held) AS withheld_documents, count(DISTINCT tier) > 1 AS mixed_trust_tiers, coalesce(any_value(xc.cards), 0) AS cards, any_value(summary) AS summary FROM x LEFT JOIN xc USING (run_id) JOIN summed USING (run_id) GROUP BY run_id"""
)


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    run = _runs(spark, sf_dir)
    return eventlog.event_log(run, _MADE, _SETTINGS), run.documents


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of every run: each event's place, document and the texts that name it."""
    log = _log(spark, sf_dir)[0]
    names = ("claim", "sha256", "text", "generated_at", "source", "id", "cards", "bytes", "line_start", "findings", "flags", "mixed_trust_tiers")
    own = log.select("run_id", "pos", "event", "doc", F.json_tuple("json", *names).alias(*[f"_{n}" for n in names]))  # an event is parsed once
    at = lambda *names: F.coalesce(*[f"_{n}" for n in names])
    return own.select("run_id", "pos", "event", F.col("doc").alias("i"), at("claim", "sha256", "text", "generated_at").alias("content"), at("source", "id").alias("name"), at("cards", "bytes", "line_start").cast("long").alias("size"), at("findings", "flags", "mixed_trust_tiers").alias("marks"))


RUN_EVENTS = (
    _SQL_RUNS
    + f""", rn AS (SELECT ia.*, count(rank) AS n FROM ia LEFT JOIN cards USING (doc_id) GROUP BY ALL), rp AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY run_id ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rn),
rf AS (SELECT doc_id, '[' || coalesce(string_agg('"' || f || '"', ','), '') || ']' AS f FROM (SELECT doc_id, unnest(string_split(findings, ',')) AS f FROM few JOIN (SELECT DISTINCT doc_id, findings FROM l) USING (doc_id)) WHERE f <> '' GROUP BY doc_id),
rt AS (SELECT run_id, sum(n + 2) AS total, count(DISTINCT tier) > 1 AS mixed FROM rn GROUP BY run_id)
SELECT run_id, (before + 1)::BIGINT AS pos, 'doc' AS event, ordinal - 1 AS i, sha AS content, name, bytes AS size, coalesce(rf.f, '[]') AS marks FROM rp LEFT JOIN rf USING (doc_id)
UNION ALL SELECT rp.run_id, (before + 1 + rank)::BIGINT, 'card', ordinal - 1, claim, rp.name, cards.line_start, '[' || coalesce(nullif('"' || replace({SQL_FLAGS}, ',', '","') || '"', '""'), '') || ']' FROM rp JOIN cards USING (doc_id)
UNION ALL SELECT run_id, (before + 2 + n)::BIGINT, 'end', ordinal - 1, NULL, NULL, n, NULL FROM rp
UNION ALL SELECT run_id, (total + 1)::BIGINT, 'summary', NULL, summary, NULL, NULL, NULL FROM rt JOIN summed USING (run_id) UNION ALL SELECT run_id, (total + 2)::BIGINT, 'manifest', NULL, '{_MADE}', run_id, NULL, mixed::VARCHAR FROM rt"""
)


def run_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of all runs held against their documents, once some documents' events have been dropped, doubled, moved or
    changed on the way."""
    log, docs = _log(spark, sf_dir)
    log = cut(log)  # it is read once for what is doubled and once for the rest
    n = F.col("doc") * 7 + F.length("run_id")
    own = log.withColumns({"a": F.coalesce(F.when(n % 23 == 5, F.col("doc") + 1.5).otherwise(F.col("doc")), F.lit(1e9)), "n": n})
    own = own.withColumn("json", F.when((F.col("event") == "doc") & (F.col("n") % 29 == 6), F.regexp_replace("json", '"sha256":"....', '"sha256":"0000')).otherwise(F.col("json")))
    own = own.where("not coalesce(n % 17 = 3, false)")
    own = own.unionByName(own.where("n % 19 = 4").withColumn("a", F.col("a") + 0.25))
    facts = docs.select("run_id").distinct().select("run_id", F.lit(_MADE).alias("generated_at"), F.lit(json.dumps(_SETTINGS)).alias("settings"))
    return eventlog.echo_errors(own, docs, facts, ["a", "pos"]).where("error in ('dropped', 'doubled', 'moved', 'changed', 'generated-at', 'no-manifest', 'inputs')")


RUN_ECHO = f"""WITH d AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY name) - 1 AS i, sha FROM (SELECT {SQL_RUN} AS run_id, printf('%s/%02d', source, doc_id) AS name, sha256(text) AS sha FROM documents)),
k AS (SELECT *, i * 7 + length(run_id) AS n FROM d), g AS (SELECT run_id, i, n, CASE WHEN n % 29 = 6 THEN '0000' || substr(sha, 5) ELSE sha END AS sha, CASE WHEN n % 23 = 5 THEN i + 1.5 ELSE i END AS a FROM k WHERE n % 17 <> 3),
log AS (SELECT * FROM g UNION ALL SELECT run_id, i, n, sha, a + 0.25 FROM g WHERE n % 19 = 4),
f AS (SELECT run_id, i, min(a) AS a, count(*) AS times, arg_min(sha, a) AS sha FROM log GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a) AS x, row_number() OVER (PARTITION BY run_id ORDER BY i) AS y FROM f)
SELECT run_id, 'dropped' AS error, i FROM d ANTI JOIN f USING (run_id, i) UNION ALL SELECT run_id, 'doubled', i FROM f WHERE times > 1 UNION ALL SELECT run_id, 'moved', i FROM p WHERE x <> y UNION ALL SELECT run_id, 'changed', i FROM f JOIN d USING (run_id, i) WHERE f.sha <> d.sha"""


def withheld_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes over the cap, or cut inside a character, keep their digest alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("case when doc_id % 5 = 0 then unhex(concat(hex(text), 'C3')) else encode(text, 'UTF-8') end").alias("content"))
    return C.withhold(docs, max_bytes=4000).select("doc_id", "sha256", "withheld", "reason", T.token_count("text").alias("tokens"))


WITHHELD_DOCUMENTS = rf"""WITH d AS (SELECT doc_id, text, doc_id % 5 = 0 AS bad, encode(text) || CASE WHEN doc_id % 5 = 0 THEN '\xC3'::BLOB ELSE ''::BLOB END AS b FROM documents),
r AS (SELECT *, CASE WHEN octet_length(b) > 4000 THEN 'input-cap' WHEN bad THEN 'redaction-error' END AS reason FROM d)
SELECT doc_id, sha256(b) AS sha256, reason IS NOT NULL AS withheld, reason, CASE WHEN reason IS NULL THEN {SQL_TOKENS.format('text')} ELSE 0 END AS tokens FROM r"""


def hook_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool answers; every seventh is in the cache under these settings, every eleventh under others."""
    calls = documents(spark, sf_dir).select(F.col("doc_id").alias("call_id"), F.when(F.col("doc_id") % 3 == 0, "off").otherwise("on").alias("surface"), F.coalesce("lang", F.lit("untrusted")).alias("tool"), F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("text"))
    key = lambda **how: T.entry_key(T.digest("text"), condense.hook_settings(**how))
    cache = calls.where("call_id % 7 = 0 and text is not null").select(key().alias("entry_key"), F.lit("kept summary").alias("summary")).unionByName(calls.where("call_id % 11 = 0 and text is not null").select(key(max_cards=5).alias("entry_key"), F.lit("of other settings").alias("summary"))).distinct()
    return condense.hook(calls, cache, {"on": True, "off": False}, minimum_tokens=150)


HOOK_OUTCOMES = (
    SQL_CARDS
    + sql_summary("doc_id", "SELECT doc_id::VARCHAR AS run_id, doc_id, 'task-return' AS name, sha256(text) AS sha, coalesce(lang, 'untrusted') AS tier FROM documents")
    + f""", hc AS (SELECT doc_id AS call_id, doc_id % 3 <> 0 AS wanted, CASE WHEN doc_id % 13 <> 0 THEN text END AS text, coalesce(lang, 'untrusted') AS tool FROM documents),
hk AS (SELECT DISTINCT text, tool FROM hc WHERE call_id % 7 = 0 AND text IS NOT NULL),
hj AS (SELECT call_id, hc.text, coalesce({SQL_TOKENS.format('hc.text')}, 0)::BIGINT AS tokens, wanted, hk.text IS NOT NULL AS kept, CASE WHEN hk.text IS NOT NULL THEN 'kept summary' ELSE summary END AS new FROM hc LEFT JOIN hk ON hk.text = hc.text AND hk.tool = hc.tool LEFT JOIN summed ON run_id = call_id::VARCHAR),
ho AS (SELECT *, CASE WHEN text IS NULL THEN 'withheld' WHEN NOT wanted OR tokens < 150 THEN 'bypass' WHEN round_even((tokens - {SQL_TOKENS.format('new')}) / tokens, 4) < 0.25 THEN 'bypass' WHEN kept THEN 'hit' ELSE 'miss' END AS outcome FROM hj)
SELECT call_id, tokens, outcome, CASE WHEN outcome IN ('hit', 'miss') THEN new WHEN outcome = 'bypass' THEN text END AS handed_on FROM ho"""
)

# -- formats ---------------------------------------------------------------------------------------------------------


def sql_field(c: str) -> str:
    quoted = c
    for raw, mark in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        quoted = f"replace({quoted}, {raw}, {mark})"
    odd = rf"""({c} = '' OR regexp_matches({c}, '^\s|\s$') OR regexp_matches({c}, '[\n\r\t\\"\[\]{{}}:]') OR lower({c}) IN ('true', 'false', 'null'))"""
    return f"CASE WHEN {c} IS NULL THEN 'null' WHEN {odd} THEN '\"' || {quoted} || '\"' ELSE {c} END"


def card_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of cards as JSON lines and as a row encoding: tokens of both, what the latter saves, and the choice."""
    return analyze.choose_card_format(_cards(spark, sf_dir).withColumn("source", F.format_string("doc-%06d", "doc_id")), wanted="auto", minimum=0.4)


_VIEW = ["printf('src-%03d', rank)", "name", "tier", "line_start::VARCHAR", "line_end::VARCHAR", f"replace({sql_defanged('claim')}, '`', '''')", "confidence", "flags"]
CARD_FORMATS = SQL_CARDS + f""", v AS (SELECT {SQL_RUN} AS run_id, doc_id, rank, printf('doc-%06d', doc_id) AS name, coalesce(lang, 'untrusted') AS tier, sha256(text) AS sha256, line_start, line_end, claim, evidence, CASE WHEN class = 1 OR regexp_matches(claim, '{SQL_URL}') THEN 'medium' ELSE 'low' END AS confidence, {SQL_FLAGS} AS flags FROM cards JOIN documents USING (doc_id)),
w AS (SELECT run_id, doc_id, rank, {SQL_TOKENS.format("to_json({'card_id': printf('src-%03d', rank), 'claim': claim, 'confidence': confidence, 'evidence': evidence, 'flags': CASE WHEN flags = '' THEN [] ELSE string_split(flags, ',') END, 'line_end': line_end, 'line_start': line_start, 'sha256': sha256, 'source': name, 'trust_tier': tier})::VARCHAR")} AS n, '  ' || {" || chr(9) || ".join(sql_field(c) for c in _VIEW)} AS line FROM v),
t AS (SELECT run_id, sum(n)::BIGINT AS primary_tokens, 'cards[' || count(*) || ']{{{",".join(analyze.VIEW)}}} delimiter="\\t":' || chr(10) || string_agg(line, chr(10) ORDER BY doc_id, rank) || chr(10) AS toon FROM w GROUP BY run_id),
u AS (SELECT *, {SQL_TOKENS.format('toon')}::BIGINT AS toon_tokens FROM t)
SELECT *, (primary_tokens - toon_tokens) / primary_tokens AS savings, (primary_tokens - toon_tokens) / primary_tokens >= 0.4 AS selected FROM u"""


def row_set_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of nations, by region: uniform rows inside an object, ragged rows, and text that is no JSON."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    uniform = n.select(F.concat(F.lit("u"), "n_regionkey").alias("source"), F.to_json(F.struct(F.struct(F.transform("rows", lambda r: F.struct(r.n_nationkey.alias("key"), r.n_name.alias("name"))).alias("nation rows")).alias("items"))).alias("value"))
    ragged = n.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit('[{"a":'), "n_regionkey", F.lit('},{"b":1}]')).alias("value"))
    wrong = n.select(F.concat(F.lit("x"), "n_regionkey").alias("source"), F.lit("{no json").alias("value"))
    return analyze.analyze(uniform.unionByName(ragged).unionByName(wrong), minimum=0.2)


ROW_SET_ANALYSIS = f"""WITH n AS (SELECT n_regionkey AS k, to_json(list({{'key': n_nationkey, 'name': n_name}} ORDER BY n_nationkey))::VARCHAR AS j, count(*) AS n, string_agg('  ' || n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey),
t AS (SELECT *, 'items_nation_rows[' || n || ']{{key,name}} delimiter="\\t":' || chr(10) || body || chr(10) AS toon FROM n),
u AS (SELECT 'u' || k AS source, '$.items.nation rows' AS path, 'items_nation_rows' AS name, n AS rows, {SQL_TOKENS.format('j')}::BIGINT AS json_tokens, {SQL_TOKENS.format('toon')}::BIGINT AS toon_tokens, toon FROM t
  UNION ALL SELECT 'r' || k, NULL, NULL, 0, {SQL_TOKENS.format("('[{" + '"a":' + "' || k || '},{" + '"b":1}]' + "')")}, NULL, NULL FROM n UNION ALL SELECT 'x' || k, NULL, NULL, 0, 0, NULL, NULL FROM n)
SELECT source, path, name, rows, json_tokens, toon_tokens, (json_tokens - toon_tokens) / json_tokens AS savings, CASE WHEN (json_tokens - toon_tokens) / json_tokens >= 0.2 THEN 'toon' ELSE 'compact-json' END AS recommended, toon FROM u"""

# -- bindings, packing, inheritance ----------------------------------------------------------------------------------


def claim_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first claims expected of its run: as they are, from other lines, or with other words."""
    cards = cut(_cards(spark, sf_dir)).select(F.col("run_id").alias("case_id"), F.format_string("doc-%d", "doc_id").alias("source"), "claim", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "card_rank", "doc_id")
    k = F.col("doc_id") % 3
    wanted = cards.where("card_rank = 1").select("case_id", F.when(k == 1, F.concat("claim", F.lit("!?"))).otherwise(F.substring("claim", 1, 30)).alias("claim"), "source", (F.col("line_start") + (k == 2).cast("long")).alias("line_start"), "line_end")
    return rules.bound_claims(wanted, cards.select("case_id", "claim", "source", "line_start", "line_end"))


CLAIM_BINDINGS = SQL_CARDS + f""", bx AS (SELECT {SQL_RUN} AS case_id, printf('doc-%d', doc_id) AS source, claim, line_start, line_end, rank, doc_id FROM cards),
ex AS (SELECT DISTINCT case_id, CASE doc_id % 3 WHEN 1 THEN claim || '!?' ELSE left(claim, 30) END AS claim, source, line_start + (doc_id % 3 = 2)::INT AS line_start, line_end FROM bx WHERE rank = 1)
SELECT ex.case_id, ex.claim, ex.source, ex.line_start, ex.line_end, coalesce(bool_and(bx.source = ex.source AND bx.line_start = ex.line_start AND bx.line_end = ex.line_end) FILTER (contains(bx.claim, ex.claim)), FALSE) AS bound FROM ex LEFT JOIN bx USING (case_id) GROUP BY ALL"""


def packed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each region's nations, in order, packed into replies of at most 24 characters."""
    nation = table(spark, sf_dir, "nation")
    return rules.pack(nation, "n_regionkey", "n_name", "n_nationkey", 24).select("key", "reply", F.array_join("items", ",").alias("items"))


PACKED_REPLIES = """WITH RECURSIVE n AS (SELECT n_regionkey AS k, n_name AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
p AS (SELECT k, i, x, 1 AS reply, length(x) AS size FROM n WHERE i = 1
  UNION ALL SELECT n.k, n.i, n.x, CASE WHEN size + 1 + length(n.x) <= 24 THEN reply ELSE reply + 1 END, CASE WHEN size + 1 + length(n.x) <= 24 THEN size + 1 + length(n.x) ELSE length(n.x) END FROM p JOIN n ON n.k = p.k AND n.i = p.i + 1)
SELECT k::VARCHAR AS "key", reply, string_agg(x, ',' ORDER BY i) AS items FROM p GROUP BY k, reply"""


def inherited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as children of the suppliers of their number: who has none, and in which fields they differ."""
    kids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), F.col("c_custkey").alias("parent_id"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 2).cast("int").alias("parity"))
    parents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 4).cast("int").alias("parity"))
    return rules.inherits(kids, parents, ["nation", "parity"]).select("child", "missing_parent", F.array_join("differs", ",").alias("differs"))


INHERITED_FIELDS = """SELECT c_custkey AS child, s_suppkey IS NULL AS missing_parent, CASE WHEN s_suppkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c_nationkey IS DISTINCT FROM s_nationkey THEN 'nation' END, CASE WHEN c_custkey % 2 <> s_suppkey % 4 THEN 'parity' END) END AS differs FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""

_ALL = (defanged_lines, summary_text, condensed_run, run_events, run_echo, withheld_documents, hook_outcomes, card_formats, row_set_analysis, claim_bindings, packed_replies, inherited_fields)

QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {name: sql for name in QUERIES if (sql := globals().get(name.upper()))}

