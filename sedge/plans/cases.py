"""Queries of quality cases: 16 neighbouring documents each, held against what was expected of them; and SQL that judges too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.spread import cut
from sedge.operators import quality, render
from sedge.plans.registry import SQL_CARDS, SQL_CRITICAL, SQL_QUESTION, _cards, table

SIZE = 16


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations from each document's first claim, its kind by the document's place, in even cases also by what the
    claim is; manifests, cards and summaries are
    broken in a way of its own for each case of eight."""
    d, case = F.col("doc_id") % SIZE, F.floor(F.col("doc_id") / SIZE)
    name, broken = F.format_string("doc-%d", "doc_id"), lambda k, at: (case % 8 == k) & (d == at)
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", case.alias("case_id"), d.cast("int").alias("at"), name.alias("source"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.coalesce("lang", F.lit("-")).alias("trust_tier"), F.size(F.split("text", "\n")).alias("lines")))  # read for inputs, cases, cards and manifests
    own = _cards(spark, sf_dir).select("doc_id", "card_rank", "claim", "evidence", "flags", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"))
    cards = cut(own.join(docs.select("doc_id", "case_id", "source", "sha256", "trust_tier"), "doc_id").select(
        "doc_id", "case_id", (d * 100 + F.col("card_rank")).cast("int").alias("at"), "card_rank", "claim", "evidence", F.when(d == 8, F.array_union("flags", F.array(F.lit("redacted")))).otherwise(F.col("flags")).alias("flags"),
        F.when(broken(6, 7), "doc-x").otherwise(F.col("source")).alias("source"), "sha256", F.when(broken(4, 6), "x").otherwise(F.col("trust_tier")).alias("trust_tier"), "line_start", "line_end",
        T.is_critical(F.col("claim")).alias("critical"), T.is_question(F.col("claim")).alias("question"),
    ))
    kinds = {0: "constraints", 1: "forbidden_constraints", 2: "open_questions", 8: "redacted_claims", 9: "forbidden_fragments", 10: "clean_claims", 11: "claim_provenance", 12: "clean_sources", 13: "constraints", 14: "open_questions", 15: "claim_provenance"}
    kind = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)])[d.cast("int")]
    right = F.when(F.col("critical"), "constraints").when(F.col("question"), "open_questions").otherwise("clean_claims")
    kind = F.when((case % 2 == 0) & d.isin(0, 2, 13, 14), right).otherwise(kind)
    text = F.when((d == 9) & (case % 2 == 0), F.concat(F.lit("zq-"), F.col("doc_id").cast("string"))).otherwise(F.substring("claim", 1, 16))
    expected = cut(cards.where("card_rank = 1").select("case_id", kind.alias("kind"), d.cast("int").alias("at"), text.alias("text"), "source", "line_start", (F.col("line_end") + ((d == 11) & (case % 3 == 0)).cast("int")).alias("line_end")).where("kind is not null"))
    places = F.array_compact(F.array(F.when(F.col("critical"), "critical"), F.when(F.col("question"), "question"), F.lit("summary")))
    cases = docs.select("case_id").distinct()
    reopen = F.filter(F.array(*map(F.lit, render.REOPEN)), lambda x: (F.col("case_id") % 8 != 5) | (x != render.REOPEN[-1]))
    lines = cards.select("case_id", F.explode(places).alias("place"), F.col("claim").alias("line")).unionByName(cases.select("case_id", F.lit("summary").alias("place"), F.explode(reopen).alias("line")))
    manifest = docs.where(~broken(1, 3)).select("case_id", "at", F.when(broken(3, 5), F.format_string("doc-%d", F.col("doc_id") - 1)).otherwise(F.col("source")).alias("source"), "sha256", (F.col("bytes") + broken(2, 4).cast("long")).alias("bytes"), "trust_tier")
    return quality.verdicts(cases, expected, cards, lines, docs, manifest, render.REOPEN)


def quality_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each case: what was expected and met, dimension by dimension, and what failed."""
    return _verdicts(spark, sf_dir).withColumn("failures", F.array_join("failures", ","))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases' verdicts as one report, against a list of cases that holds them at their places."""
    found = _verdicts(spark, sf_dir).withColumn("at", F.col("case_id"))
    listed = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / SIZE).alias("case_id")).distinct().withColumn("at", F.col("case_id"))
    return quality.report(found, listed)


_REOPEN = "(VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in render.REOPEN) + ") v(line)"
_NONE = "FALSE AS red, NULL::VARCHAR AS source, NULL::BIGINT AS line_start, NULL::BIGINT AS line_end"
_VERDICTS = SQL_CARDS + f""", dx AS (SELECT doc_id, doc_id // 16 AS c, doc_id % 16 AS d, 'doc-' || doc_id AS source, sha256(text) AS sha, strlen(text) AS bytes, coalesce(lang, '-') AS tier, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents),
kx AS (SELECT c, d, rank, d * 100 + rank AS nth, claim, evidence, findings <> '' OR d = 8 AS red, CASE WHEN c % 8 = 6 AND d = 7 THEN 'doc-x' ELSE source END AS source, sha, CASE WHEN c % 8 = 4 AND d = 6 THEN 'x' ELSE tier END AS tier, line_start, line_end,
  regexp_matches(claim, '{SQL_CRITICAL}') AS critical, regexp_matches(claim, '{SQL_QUESTION}') AS question FROM cards JOIN dx USING (doc_id)),
ex AS (SELECT c, d AS nth, CASE WHEN c % 2 = 0 AND d IN (0, 2, 13, 14) THEN CASE WHEN critical THEN 'constraints' WHEN question THEN 'open_questions' ELSE 'clean_claims' END WHEN d IN (0, 13) THEN 'constraints' WHEN d = 1 THEN 'forbidden_constraints' WHEN d IN (2, 14) THEN 'open_questions' WHEN d = 8 THEN 'redacted_claims' WHEN d = 9 THEN 'forbidden_fragments' WHEN d = 10 THEN 'clean_claims' WHEN d IN (11, 15) THEN 'claim_provenance' WHEN d = 12 THEN 'clean_sources' END AS kind,
  CASE WHEN d = 9 AND c % 2 = 0 THEN 'zq-' || (c * 16 + d) ELSE left(claim, 16) END AS want, source, line_start, line_end + (d = 11 AND c % 3 = 0)::INT AS line_end FROM kx WHERE rank = 1),
cx AS (SELECT DISTINCT c FROM dx),
tx AS (SELECT c, 'card' AS place, claim AS line, red, source, line_start, line_end FROM kx UNION ALL SELECT c, 'critical', claim, {_NONE} FROM kx WHERE critical UNION ALL SELECT c, 'question', claim, {_NONE} FROM kx WHERE question
  UNION ALL SELECT c, 'summary', claim, {_NONE} FROM kx UNION ALL SELECT c, 'other', evidence, {_NONE} FROM kx UNION ALL SELECT c, 'summary', line, {_NONE} FROM cx, {_REOPEN} WHERE c % 8 <> 5 OR line <> '{render.REOPEN[-1]}'),
hx AS (SELECT ex.c, ex.kind, ex.nth, tx.place, tx.red, tx.source = ex.source AND tx.line_start = ex.line_start AND tx.line_end = ex.line_end AS bound FROM ex JOIN tx ON ex.c = tx.c AND contains(tx.line, ex.want)),
yx AS (SELECT ex.c, ex.kind, ex.nth, count(*) FILTER (place = 'card') AS n_card, count(*) FILTER (place = 'card' AND NOT red) AS n_open, count(*) FILTER (place = 'card' AND NOT bound) AS n_astray, count(*) FILTER (place = 'critical') AS n_critical, count(*) FILTER (place = 'question') AS n_question,
  count(*) FILTER (place IN ('critical', 'question', 'summary')) AS n_summary, count(place) AS n_any FROM ex LEFT JOIN hx ON ex.c = hx.c AND ex.kind = hx.kind AND ex.nth = hx.nth WHERE ex.kind <> 'clean_sources' GROUP BY ALL),
zx AS (SELECT *, CASE kind WHEN 'constraints' THEN n_critical > 0 AND n_card > 0 WHEN 'forbidden_constraints' THEN n_critical = 0 WHEN 'open_questions' THEN n_question > 0 AND n_card > 0 WHEN 'redacted_claims' THEN n_card > 0 AND n_open = 0 AND n_summary > 0
  WHEN 'forbidden_fragments' THEN n_any = 0 WHEN 'clean_claims' THEN n_card > 0 AND n_summary > 0 ELSE n_card > 0 AND n_astray = 0 END AS met FROM yx),
px AS (SELECT c, d AS nth, CASE WHEN c % 8 = 3 AND d = 5 THEN 'doc-' || (doc_id - 1) ELSE source END AS source, sha, bytes + (c % 8 = 2 AND d = 4)::INT AS bytes, tier FROM dx WHERE NOT (c % 8 = 1 AND d = 3)),
nx AS (SELECT c, count(*) AS n, (SELECT count(*) FROM px WHERE px.c = dx.c) AS m FROM dx GROUP BY c),
lx AS (SELECT px.c, px.nth, px.source, dx.source IS NOT NULL AND row_number() OVER (PARTITION BY px.c, px.source ORDER BY px.nth) = 1 AS fresh, px.sha IS DISTINCT FROM dx.sha OR px.bytes IS DISTINCT FROM dx.bytes OR px.tier <> dx.tier AS differs FROM px JOIN nx ON nx.c = px.c AND n = m LEFT JOIN dx ON dx.c = px.c AND dx.source = px.source),
ox AS (SELECT kx.*, dx.source IS NOT NULL AS known, kx.sha IS DISTINCT FROM dx.sha OR kx.tier <> dx.tier OR NOT (1 <= line_start AND line_start <= line_end AND line_end <= n_lines) AS differs FROM kx LEFT JOIN dx ON dx.c = kx.c AND dx.source = kx.source),
fx AS (SELECT c, CASE kind WHEN 'constraints' THEN 'constraints.missing' WHEN 'forbidden_constraints' THEN 'constraints.forbidden' WHEN 'open_questions' THEN 'open_questions.missing' WHEN 'redacted_claims' THEN 'redaction.required_claim_missing' WHEN 'forbidden_fragments' THEN 'redaction.forbidden_fragment'
    WHEN 'clean_claims' THEN 'redaction.clean_claim_missing' ELSE 'provenance.claim_binding' END || '[' || nth || ']' AS code FROM zx WHERE NOT met
  UNION ALL SELECT kx.c, 'redaction.clean_source_violation[' || kx.nth || ']' FROM kx JOIN ex ON ex.c = kx.c AND ex.source = kx.source AND ex.kind = 'clean_sources' WHERE red OR contains(claim, '[REDACTED]') OR contains(evidence, '[REDACTED]')
  UNION ALL SELECT c, 'redaction.clean_artifact_violation' FROM cx WHERE (SELECT bool_and(EXISTS (FROM ex WHERE ex.c = dx.c AND ex.source = dx.source AND kind = 'clean_sources')) FROM dx WHERE dx.c = cx.c) AND EXISTS (FROM tx WHERE tx.c = cx.c AND contains(line, '[REDACTED]'))
  UNION ALL SELECT c, 'provenance.manifest_input_count' FROM nx WHERE n <> m UNION ALL SELECT c, 'provenance.manifest_source[' || nth || ']' FROM lx WHERE NOT fresh UNION ALL SELECT c, 'provenance.manifest_metadata[' || nth || ']' FROM lx WHERE fresh AND differs
  UNION ALL SELECT c, 'provenance.manifest_sources_incomplete' FROM nx WHERE n <> (SELECT count(*) FROM lx WHERE lx.c = nx.c AND fresh) UNION ALL SELECT c, 'provenance.card_source[' || nth || ']' FROM ox WHERE NOT known UNION ALL SELECT c, 'provenance.card_metadata[' || nth || ']' FROM ox WHERE known AND differs
  UNION ALL SELECT c, 'provenance.card_sources_incomplete' FROM nx WHERE n <> (SELECT count(DISTINCT source) FROM ox WHERE ox.c = nx.c AND known) UNION ALL SELECT c, 'provenance.source_reopen_instructions' FROM cx WHERE (SELECT count(DISTINCT v.line) FROM tx JOIN {_REOPEN} ON contains(tx.line, v.line) WHERE tx.c = cx.c AND place IN ('critical', 'question', 'summary')) < {len(render.REOPEN)}),
gx AS (SELECT c, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_expected, count(*) FILTER (kind = '{k}' AND met) AS {k}_met" for k in quality.KINDS)} FROM zx GROUP BY c),
ux AS (SELECT c, string_agg(DISTINCT code, ',' ORDER BY code) AS failures, {", ".join(f"count(*) FILTER (starts_with(code, '{d}.')) AS {d}_n" for d in quality.DIMENSIONS)} FROM fx GROUP BY c),
vx AS (SELECT cx.c AS case_id, {", ".join(f"coalesce({k}_{x}, 0) AS {k}_{x}" for k in quality.KINDS for x in ("expected", "met"))}, (SELECT count(DISTINCT source) FROM ex WHERE ex.c = cx.c AND kind = 'clean_sources') AS clean_sources, (SELECT n FROM nx WHERE nx.c = cx.c) AS sources,
  {", ".join(f"coalesce({d}_n, 0) = 0 AS {d}_ok" for d in quality.DIMENSIONS)}, ux.c IS NULL AS passed, coalesce(failures, '') AS failures FROM cx LEFT JOIN gx USING (c) LEFT JOIN ux USING (c)),
wx AS (SELECT *, constraints_expected + forbidden_constraints_expected > 0 AS constraints_applies, open_questions_expected > 0 AS open_questions_applies, redacted_claims_expected + forbidden_fragments_expected + clean_claims_expected + clean_sources > 0 AS redaction_applies, sources > 0 AS provenance_applies FROM vx)"""
QUALITY_CASES = _VERDICTS + " FROM wx"
QUALITY_REPORT = _VERDICTS + ", rx AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(*) AS cases_total, count(*) FILTER ({d}_applies) AS cases_applicable, count(*) FILTER ({d}_applies AND {d}_ok) AS cases_passed FROM wx" for d in quality.DIMENSIONS) + """),
qx AS (SELECT *, cases_applicable > 0 AND cases_passed = cases_applicable AS ok FROM rx)
SELECT *, TRUE AS in_order FROM qx UNION ALL SELECT 'gate', (SELECT count(*) FROM wx), (SELECT count(*) FROM wx), (SELECT count(*) FILTER (passed) FROM wx), (SELECT bool_and(ok) FROM qx) AND (SELECT bool_and(passed) FROM wx), TRUE"""

_ALL = (quality_cases, quality_report)

QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {"quality_cases": QUALITY_CASES, "quality_report": QUALITY_REPORT}
