"""Queries over the driver's tables by name, and the SQL that says the same.

Where a table lacks what an operator is for, the query applies it to the nearest thing there is: turns of a conversation
stand for tool calls and results, a document's source for a run's cohort, its language for a trust tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import patterns as P
from sedge.functions import text as T
from sedge.functions.spread import cut, spread
from sedge.operators import cards as C
from sedge.operators import chatlog, ledger, recall, render, rules, usage

# Cards of a document at most, and documents of a request.
MAX_CARDS, MAX_DOCUMENTS = 24, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores: each is much work."""
    return spread(table(spark, sf_dir, "documents"))


# -- text ----------------------------------------------------------------------------------------------------------

SQL_TOKENS = r"len(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]'))"


def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), T.token_count("text").alias("n_tokens"), T.digest("text").alias("sha256"))


TOKEN_PROFILE = f"SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, {SQL_TOKENS.format('text')}::BIGINT AS n_tokens, sha256(text) AS sha256 FROM documents"

# RE2's word edges are ASCII; letters marked on both sides by Z and a control character make them Unicode's for pattern 9,
# which can take in neither.
NON_ASCII_MARK = r"regexp_replace({0}, '([^\x00-\x7F])', 'Z' || chr(1) || '\1' || chr(1) || 'Z', 'g')"
CARD = r"replace(replace(regexp_replace(" + NON_ASCII_MARK + r", '\b(?:\d[ -]?){{13,19}}\b', '[REDACTED]', 'g'), 'Z' || chr(1), ''), chr(1) || 'Z', '')"
# The secret patterns once more, in the oracle's dialect.
STEPS = (
    r"\b(?:sk|ghp|gho|github_pat|xox[baprs])-[-_A-Za-z0-9]{16,}\b",
    r"\b(?:sk|ghp|gho|github_pat|xox[baprs])_[-_A-Za-z0-9]{16,}\b",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"-----BEGIN[A-Z ]*PRIVATE KEY-----[\s\S]+?-----END[A-Z ]*PRIVATE KEY-----",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"(?i)\b(api[_-]?key|token|password|secret)\s*[:=]\s*[''\"]?[^''\"\s]{8,}",
)


def sql_redacted(source: str, key: str, text: str) -> str:
    """CTEs r0 (before) to r9 (all nine patterns), with what matched in h1 to h9."""
    out = [f"r0 AS (SELECT {key}, regexp_replace({text}, '\\r\\n?', chr(10), 'g') AS t FROM {source})"]
    hits = ""
    for k, p in enumerate(STEPS, 1):
        out.append(f"r{k} AS (SELECT {key}{hits}, regexp_matches(t, '{p}') AS h{k}, regexp_replace(t, '{p}', '[REDACTED]', 'g') AS t FROM r{k - 1})")
        hits += f", h{k}"
    out.append(f"r9 AS (SELECT {key}{hits}, {CARD.format('t')} <> t AS h9, {CARD.format('t')} AS t FROM r8)")
    return ", ".join(out)


def _redacted(spark: SparkSession, sf_dir: str, upto: int = 9) -> DataFrame:
    return T.redact(documents(spark, sf_dir).select("doc_id", "text"), upto=upto)


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir).select("doc_id", F.array_join("findings", ",").alias("findings"), T.digest("redacted").alias("sha256"))


FINDINGS = "concat_ws(',', " + ", ".join(f"CASE WHEN h{k} THEN 'pattern-{k}' END" for k in range(1, 10)) + ")"
REDACTED_DOCUMENTS = f"WITH {sql_redacted('documents', 'doc_id', 'text')} SELECT doc_id, {FINDINGS} AS findings, sha256(t) AS sha256 FROM r9"


def findings_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.redact(spread(table(spark, sf_dir, "pages")).select(F.col("html").alias("text"))).select(F.lit("pages").alias("source_table"), "findings")
    docs = _redacted(spark, sf_dir).select(F.lit("documents").alias("source_table"), "findings")
    named = docs.unionByName(pages).select("source_table", F.explode_outer("findings").alias("finding")).where("finding is not null")
    return named.groupBy("source_table", "finding").agg(F.count("*").alias("n"))


def _counted(name: str, source: str, key: str, text: str) -> str:
    rows = " UNION ALL ".join(f"SELECT 'pattern-{k}' AS finding FROM r9 WHERE h{k}" for k in range(1, 10))
    return f"SELECT '{name}' AS source_table, finding, count(*) AS n FROM (WITH {sql_redacted(source, key, text)} {rows}) GROUP BY finding"


FINDINGS_BY_PATTERN = _counted("documents", "documents", "doc_id", "text") + " UNION ALL " + _counted("pages", "pages", "page_id", "html")

# -- lines and cards -------------------------------------------------------------------------------------------------

SQL_CRITICAL = r"(?i)(^|[^\pL\pN_])(" + "|".join(P.CRITICAL_WORDS) + r")([^\pL\pN_]|$)"
SQL_QUESTION = r"(?i)(^|\s)(" + "|".join(P.QUESTION_WORDS) + ")"
SQL_URL = r"https?://[^\s)>\]]+"
SQL_INJECTION = r"(?i)\b(ignore previous|system:|developer:|assistant:|user:|tool:|reveal secrets|exfiltrate|send to|curl\s+http|base64)\b"
SQL_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\v]+', ''), '[\s\v]+$', '')"
# text without a line break at its end has as many lines as pieces
SQL_LINES = r"""ls AS (SELECT doc_id, findings, string_split(CASE WHEN ends_with(t, chr(10)) THEN t[:-2] ELSE t END, chr(10)) AS ls, t FROM f),
l AS (SELECT doc_id, findings, i, ls, ls[i] AS line, """ + SQL_STRIP.format("ls[i]") + r""" AS bare FROM (SELECT doc_id, findings, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls WHERE t <> ''))"""


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.classified(C.line_rows(_redacted(spark, sf_dir)))
    count = lambda c: F.count_if(F.col(c))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), count("is_blank").alias("n_blank"), count("is_critical").alias("n_critical"), count("is_question").alias("n_question"), count("has_url").alias("n_url"), count("is_bullet").alias("n_bullet"))


SQL_BASE = f"WITH {sql_redacted('documents', 'doc_id', 'text')}, f AS (SELECT doc_id, {FINDINGS} AS findings, t FROM r9), {SQL_LINES}"
LINE_CLASSES = SQL_BASE + f""" SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bare = '') AS n_blank, count(*) FILTER (regexp_matches(bare, '{SQL_CRITICAL}')) AS n_critical,
count(*) FILTER (regexp_matches(bare, '{SQL_QUESTION}')) AS n_question, count(*) FILTER (regexp_matches(bare, '{SQL_URL}')) AS n_url, count(*) FILTER (regexp_matches(bare, '^[-*#]')) AS n_bullet FROM l GROUP BY doc_id"""


RUN = f"concat('run-', cast(floor(doc_id / {MAX_DOCUMENTS}) as string))"
SQL_RUN = f"'run-' || (doc_id // {MAX_DOCUMENTS})"


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents; runs are of up to MAX_DOCUMENTS neighbours, and a document's language stands for its tier."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce("lang", F.lit("untrusted")).alias("trust_tier"), "source", F.expr(RUN).alias("run_id"))
    return T.redact(docs).withColumn("sha256", T.digest("text")).drop("text")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(_own(spark, sf_dir), MAX_CARDS)


def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select("doc_id", "card_id", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "confidence", "claim", "evidence", F.array_join("flags", ",").alias("flags"))


SQL_CARDS = SQL_BASE + rf""", c AS (SELECT *, CASE WHEN bare = '' THEN 4 WHEN regexp_matches(bare, '{SQL_CRITICAL}') OR regexp_matches(bare, '{SQL_QUESTION}') THEN 1 WHEN regexp_matches(bare, '{SQL_URL}') OR regexp_matches(bare, '^[-*#]') THEN 2 ELSE 3 END AS class FROM l),
d AS (SELECT *, min(class) OVER (PARTITION BY doc_id) <= 2 AS named, row_number() OVER (PARTITION BY doc_id, class = 3 ORDER BY i) AS nth FROM c),
e AS (SELECT *, {SQL_STRIP.format(r"regexp_replace(bare, '^[-*#>\s0-9.]+', '')")} AS cleaned FROM d WHERE CASE WHEN named THEN class <= 2 ELSE class = 3 AND nth <= {MAX_CARDS} END),
g AS (SELECT *, CASE WHEN length(cleaned) > CASE class WHEN 1 THEN 4096 ELSE 220 END THEN regexp_replace(left(cleaned, CASE class WHEN 1 THEN 4095 ELSE 219 END), '\s+$', '') || '...' ELSE cleaned END AS claim FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim, class ORDER BY i) AS again FROM g WHERE claim <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY class, i) AS rank, greatest(i - 1, 1) AS line_start, least(i + 1, len(ls)) AS line_end FROM h WHERE class = 1 OR again = 1),
cards AS (SELECT *, {SQL_STRIP.format("array_to_string(ls[line_start:line_end], chr(10))")} AS evidence FROM k WHERE rank <= {MAX_CARDS})"""
SQL_FLAGS = f"concat_ws(',', CASE WHEN findings <> '' THEN 'redacted' END, CASE WHEN regexp_matches(evidence, '{SQL_INJECTION}') THEN 'injection-shaped' END, CASE WHEN regexp_matches(evidence, '{SQL_URL}') THEN 'has-url' END)"
SOURCE_CARDS = SQL_CARDS + f" SELECT doc_id, printf('src-%03d', rank) AS card_id, line_start, line_end, CASE WHEN class = 1 OR regexp_matches(claim, '{SQL_URL}') THEN 'medium' ELSE 'low' END AS confidence, claim, evidence, {SQL_FLAGS} AS flags FROM cards"


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr(RUN).alias("run_id"), "doc_id", "source", T.digest("text").alias("sha256"), F.coalesce("lang", F.lit("untrusted")).alias("trust_tier"))


def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.section_rows(render.numbered(_cards(spark, sf_dir), _inputs(spark, sf_dir))[0])
    return rows.groupBy("run_id", "section").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


SUMMARY_SECTIONS = SQL_CARDS + f""", m AS (SELECT {SQL_RUN} AS run_id, row_number() OVER (PARTITION BY {SQL_RUN} ORDER BY doc_id, rank) AS ord, regexp_matches(claim, '{SQL_CRITICAL}') AS a, regexp_matches(claim, '{SQL_QUESTION}') AS b FROM cards),
s AS (SELECT run_id, ord, '1-claims' AS section FROM m UNION ALL SELECT run_id, ord, '2-critical-constraints' FROM m WHERE a UNION ALL SELECT run_id, ord, '3-open-questions' FROM m WHERE b UNION ALL SELECT run_id, ord, '4-findings' FROM m WHERE NOT a AND NOT b)
SELECT run_id, section, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM s GROUP BY ALL"""


def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("run_id")).agg(F.count("*").alias("documents"), (F.count_distinct("lang") > 1).alias("mixed_trust_tiers"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("tiers"))


RUN_OVERVIEW = "SELECT source AS run_id, count(*) AS documents, count(DISTINCT lang) > 1 AS mixed_trust_tiers, array_to_string(list_sort(list(DISTINCT lang)), ',') AS tiers FROM documents GROUP BY source"


def claim_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(_own(spark, sf_dir))  # lines and cards are both taken from it
    lines = recall.recognized(docs)
    slots = recall.claim_slots(C.cards(docs, MAX_CARDS))
    return recall.status(recall.spent(lines, slots))


CLAIM_RECALL = SQL_CARDS + rf""", q AS (SELECT doc_id, i, {SQL_STRIP.format(r"regexp_replace(bare, '^[-*#>\s0-9.]+', '')")} AS full_claim, kind FROM l, (VALUES ('critical_constraints'), ('open_questions')) v(kind)
  WHERE bare <> '' AND CASE kind WHEN 'critical_constraints' THEN regexp_matches(bare, '{SQL_CRITICAL}') ELSE regexp_matches(bare, '{SQL_QUESTION}') END),
slots AS (SELECT doc_id, kind, claim AS full_claim, count(*) AS slots FROM cards, (VALUES ('critical_constraints'), ('open_questions')) v(kind)
  WHERE CASE kind WHEN 'critical_constraints' THEN regexp_matches(claim || chr(10) || evidence, '{SQL_CRITICAL}') ELSE regexp_matches(claim || chr(10) || evidence, '{SQL_QUESTION}') END
    AND NOT regexp_matches(claim, 'https?://|\]\([^)]+\)|(?i)\b(javascript|vbscript|data):') GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, full_claim ORDER BY i) AS n FROM q),
o AS (SELECT doc_id, kind, count(*) AS recognized, count(*) FILTER (n <= coalesce(slots, 0)) AS retained FROM n LEFT JOIN slots USING (doc_id, kind, full_claim) GROUP BY doc_id, kind)
SELECT *, recognized - retained AS lost, CASE WHEN recognized = retained THEN 'pass' ELSE 'recall-loss' END AS status FROM o"""


def authoritative_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy assignment of lines to cards: each card in turn takes a free line."""
    docs = cut(_own(spark, sf_dir))
    found = recall.authoritative(recall.recognized(docs), C.cards(docs, MAX_CARDS))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("retained"))


# cards one by one: each takes the line that its claim equals, else the lowest in its window, if it is still free
AUTHORITATIVE_RECALL = SQL_CARDS.replace("WITH ", "WITH RECURSIVE ", 1) + rf""", q AS (SELECT doc_id, i, bare, kind, {SQL_STRIP.format(r"regexp_replace(bare, '^[-*#>\s0-9.]+', '')")} AS whole, regexp_matches(bare, '{SQL_CRITICAL}') OR regexp_matches(bare, '{SQL_QUESTION}') AS anchor FROM l, (VALUES ('critical_constraints'), ('open_questions')) v(kind)
  WHERE bare <> '' AND CASE kind WHEN 'critical_constraints' THEN regexp_matches(bare, '{SQL_CRITICAL}') ELSE regexp_matches(bare, '{SQL_QUESTION}') END),
p AS (SELECT *, CASE WHEN length(whole) > 4096 THEN regexp_replace(left(whole, 4095), '\s+$', '') || '...' ELSE whole END AS line_claim FROM q),
o AS (SELECT c.doc_id, kind, rank, list(p.i ORDER BY line_claim <> claim, p.i) AS options FROM cards c JOIN p ON p.doc_id = c.doc_id AND p.i BETWEEN line_start AND line_end
  AND list_contains(list_transform(string_split(evidence, chr(10)), lambda x: {SQL_STRIP.format('x')}), p.bare) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY rank) AS nth FROM o),
w AS (SELECT doc_id, kind, nth, options[1:1] AS taken FROM n WHERE nth = 1
  UNION ALL SELECT n.doc_id, n.kind, n.nth, list_concat(taken, list_filter(options, lambda x: NOT list_contains(taken, x))[1:1]) FROM w JOIN n ON n.doc_id = w.doc_id AND n.kind = w.kind AND n.nth = w.nth + 1)
SELECT doc_id, kind, max(len(taken)) AS retained FROM w GROUP BY ALL"""


# -- ledgers ---------------------------------------------------------------------------------------------------------


def savings_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", T.token_count("text").alias("base_tokens"))
    claims = _cards(spark, sf_dir).groupBy("doc_id").agg(F.sum(T.token_count("claim")).alias("claim_tokens"), F.count("*").alias("n_cards"))
    own = docs.join(claims, "doc_id", "left").withColumns({"claim_tokens": F.coalesce("claim_tokens", F.lit(0)), "n_cards": F.coalesce("n_cards", F.lit(0))})
    own = own.withColumn("savings", T.savings(F.col("base_tokens"), F.col("claim_tokens")))
    return own.withColumn("outcome", chatlog.outcome(F.lit(0), F.col("n_cards"), F.col("savings")))


SAVINGS_GATE = SQL_CARDS + f""", t AS (SELECT doc_id, sum({SQL_TOKENS.format('claim')})::BIGINT AS claim_tokens, count(*) AS n_cards FROM cards GROUP BY doc_id),
u AS (SELECT doc_id, {SQL_TOKENS.format('text')}::BIGINT AS base_tokens, coalesce(claim_tokens, 0) AS claim_tokens, coalesce(n_cards, 0) AS n_cards FROM documents LEFT JOIN t USING (doc_id)),
w AS (SELECT *, CASE WHEN base_tokens > 0 THEN (base_tokens - claim_tokens) / base_tokens END AS savings FROM u)
SELECT *, CASE WHEN n_cards = 0 THEN 'no_cards' WHEN coalesce(savings < 0.25, TRUE) THEN 'below_savings_gate' ELSE 'eligible' END AS outcome FROM w"""


def handoff_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of a run: texts stand for the summary, languages for cards, ids for the row encoding."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("source").alias("run_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("artifact"), F.col(c).cast("string").alias("text")) for a, c in (("summary", "text"), ("cards", "lang"), ("toon", "doc_id"))])).alias("_a")).select("run_id", "_a.*")
    totals = ledger.handoff_totals(ledger.artifact_sizes(texts, ["run_id", "artifact"]))
    return ledger.best_handoffs(totals.withColumn("eligible", F.col("handoff") != "summary_only"))


HANDOFF_CHOICE = f"""WITH a AS (SELECT source AS run_id, sum({SQL_TOKENS.format('text')}) AS s, sum({SQL_TOKENS.format('lang')}) AS c, sum({SQL_TOKENS.format('doc_id::VARCHAR')}) AS x FROM documents GROUP BY source),
h AS (SELECT run_id, 'summary_only' AS handoff, 0 AS p, s AS tokens FROM a UNION ALL SELECT run_id, 'summary_plus_authoritative_cards', 1, s + c FROM a UNION ALL SELECT run_id, 'summary_plus_toon_compact_view', 2, s + x FROM a)
SELECT run_id, arg_min(handoff, (tokens, p)) AS best_measured, arg_min(handoff, (tokens, handoff)) FILTER (handoff <> 'summary_only') AS recommended FROM h GROUP BY run_id"""


def cohort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cohort_stats(table(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


COHORT_STATS = "SELECT lang, source, count(n_chars) AS n, min(n_chars) AS low, max(n_chars) AS high, CASE WHEN count(n_chars) >= 5 THEN quantile_disc(n_chars, 0.5) END AS p50, CASE WHEN count(n_chars) >= 5 THEN quantile_disc(n_chars, 0.9) END AS p90 FROM documents GROUP BY lang, source"


def cohort_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ledger.few_values(table(spark, sf_dir, "documents").withColumn("size", F.floor(F.col("n_chars") / 500)), ["lang", "source", "size"], "n_chars")
    return own.withColumn("values", F.array_join("values", ","))


COHORT_FEW = """SELECT lang, source, n_chars // 500 AS size, array_to_string(list_sort(list(n_chars)), ',') AS "values" FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL HAVING count(*) < 5"""


def cohort_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"long": F.col("n_chars") > 2000, "english": F.col("lang") == "en", "eligible": F.col("n_chars") > 0, "words": T.token_count("text")})
    return ledger.cohort_rates(docs, ["source"], ["long", "english"], "n_chars", "words", "eligible")


COHORT_RATES = f"""SELECT source, count(*) AS runs, count(*) FILTER (n_chars > 2000) / count(*) AS long_rate, count(*) FILTER (lang = 'en') / count(*) AS english_rate, count(*) FILTER (NOT n_chars > 0) AS excluded,
(sum(n_chars) FILTER (n_chars > 0) - sum({SQL_TOKENS.format('text')}) FILTER (n_chars > 0)) / sum(n_chars) FILTER (n_chars > 0) AS weighted_savings FROM documents GROUP BY source"""


def corpus_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each source in the order of ids and, whatever that order, of its texts: a tree of runs of 1,000 ids, and
    of 2^20 values of the first 32 bits of a digest; a text that repeats is one line with its number."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", T.digest("text").alias("sha256"), F.octet_length("text").alias("size"))
    line = F.concat_ws("|", "sha256", "lang", F.col("size").cast("string"))
    ordered = ledger.tree_digest(docs, ["source"], line, F.col("doc_id"), ["doc_id"]).withColumnRenamed("digest", "ordered")
    kinds = docs.groupBy("source", "sha256", "lang", "size").agg(F.count("*").alias("k"))
    place = F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long")
    loose = ledger.tree_digest(kinds, ["source"], F.concat_ws("|", line, F.col("k").cast("string")), place, ["sha256", "lang", "size"], fan=1 << 20, levels=2)
    return ordered.join(loose.select(F.col("source").alias("_s"), F.col("digest").alias("multiset")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


CORPUS_DIGESTS = """WITH d AS (SELECT source, doc_id, lang, sha256(text) AS s, octet_length(encode(text)) AS z, concat_ws('|', sha256(text), lang, octet_length(encode(text))::VARCHAR) AS line FROM documents),
a1 AS (SELECT source, doc_id // 1000 AS p, sha256(string_agg(line, chr(10) ORDER BY doc_id)) AS h, count(*) AS n FROM d GROUP BY ALL),
a2 AS (SELECT source, p // 1000 AS q, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM a1 GROUP BY ALL),
a AS (SELECT source, sha256(string_agg(h, chr(10) ORDER BY q)) AS ordered, sum(n)::BIGINT AS n FROM a2 GROUP BY source),
k AS (SELECT source, s, lang, z, line || '|' || count(*) AS line FROM d GROUP BY source, s, lang, z, line),
b1 AS (SELECT source, ('0x' || s[1:8])::BIGINT // 1048576 AS p, sha256(string_agg(line, chr(10) ORDER BY s, lang, z)) AS h FROM k GROUP BY ALL),
b AS (SELECT source, sha256(string_agg(h, chr(10) ORDER BY p)) AS multiset FROM b1 GROUP BY source)
SELECT source, ordered, n, multiset FROM a JOIN b USING (source)"""


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.repeats(table(spark, sf_dir, "documents").select(T.digest("text").alias("sha256"), "lang"), ["sha256", "lang"])


REPEATED_TEXTS = "SELECT sha256(text) AS sha256, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1"


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_ = {"chars-match": F.col("n_chars") == F.length("text"), "has-language": F.col("lang").isNotNull(), "not-short": F.col("n_chars") >= 200, "one-line-at-most-100k": F.col("n_chars") <= 100_000}
    return ledger.violations(table(spark, sf_dir, "documents"), rules_).select("doc_id", F.array_join("errors", ",").alias("errors")).where("errors <> ''")


DOCUMENT_RULES = """SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN NOT coalesce(n_chars = length(text), FALSE) THEN 'chars-match' END, CASE WHEN lang IS NULL THEN 'has-language' END, CASE WHEN NOT coalesce(n_chars >= 200, FALSE) THEN 'not-short' END,
CASE WHEN NOT coalesce(n_chars <= 100000, FALSE) THEN 'one-line-at-most-100k' END) AS errors FROM documents) WHERE errors <> ''"""


def toon_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    body = render.toon_rows(nation.withColumn("grp", F.col("n_regionkey").cast("string")), ["n_nationkey"], "grp", columns=["n_nationkey", "n_name"])
    return body.select("grp", render.toon_text(F.lit("nation"), F.col("n"), ["n_nationkey", "n_name"], F.col("body")).alias("toon"))


TOON_NATIONS = r"""SELECT n_regionkey::VARCHAR AS grp, 'nation[' || count(*) || ']{n_nationkey,n_name} delimiter="\t":' || chr(10) || string_agg('  ' || n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS toon FROM nation GROUP BY n_regionkey"""

# -- chat logs and usage ---------------------------------------------------------------------------------------------


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chatlog.answers(table(spark, sf_dir, "conversations"))
    return own.select("conv_id", "asked_at", "answered_at", T.token_count("question").alias("question_tokens"), T.token_count("answer").alias("answer_tokens"))


CHAT_ANSWERS = f"""WITH r AS (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lead(text) OVER w AS nx FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn AS asked_at, nt AS answered_at, {SQL_TOKENS.format('text')}::BIGINT AS question_tokens, {SQL_TOKENS.format('nx')}::BIGINT AS answer_tokens FROM r WHERE role = 'user' AND nr = 'assistant'"""


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as a log: a user's purchases answer the calls that share their value's whole part."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("pos"), F.floor(F.col("value")).cast("string").alias("id"), "event_type", F.col("props").alias("text"))
    return e.where("event_type <> 'purchase'").withColumnRenamed("event_type", "name"), e.where("event_type = 'purchase'")


def ordered_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlog.correlate_messages(*_calls(spark, sf_dir)).select("request", "pos", "id", "tool")


SQL_CALLS = "e AS (SELECT user_id AS request, event_id AS pos, floor(value)::BIGINT::VARCHAR AS id, event_type AS name FROM events)"
ORDERED_CORRELATION = f"""WITH {SQL_CALLS}, s AS (SELECT r.request, r.pos, r.id, min(c.name) AS tool, count(DISTINCT c.name) AS k FROM e r JOIN e c ON r.request = c.request AND r.id = c.id AND c.pos < r.pos AND c.name <> 'purchase' WHERE r.name = 'purchase' GROUP BY ALL) SELECT request, pos, id, tool FROM s WHERE k = 1"""


def unordered_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlog.correlate_responses(*_calls(spark, sf_dir)).select("request", "pos", "id", "tool")


UNORDERED_CORRELATION = f"""WITH {SQL_CALLS}, o AS (SELECT request, id, min(name) AS tool FROM e WHERE name <> 'purchase' GROUP BY ALL HAVING count(*) = 1) SELECT request, pos, id, tool FROM e JOIN o USING (request, id) WHERE name = 'purchase'"""


def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlog.first_documents(table(spark, sf_dir, "conversations"), MAX_DOCUMENTS, "conv_id", ("turn",)).select("conv_id", "turn", "role", "ordinal")


FIRST_TURNS = f"SELECT conv_id, turn, role, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations) WHERE ordinal <= {MAX_DOCUMENTS}"


def truncated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all events of a user, of which many have more than a request's documents."""
    return chatlog.truncated(table(spark, sf_dir, "events"), MAX_DOCUMENTS, "user_id")


TRUNCATED_TURNS = f"SELECT user_id, least(count(*), {MAX_DOCUMENTS}) AS documents, greatest(count(*) - {MAX_DOCUMENTS}, 0) AS truncated FROM events GROUP BY user_id"


def tool_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tools, as servers in both forms of a name, and as names of a server without a tool."""
    tiers = {"click": "repo_source", "mcp:view": "untrusted_web", "mcp__signup": "never", "mcp:signup": "semi_trusted_service"}
    t, k = F.col("event_type"), F.col("event_id") % 4
    name = F.when(k == 0, F.concat(F.lit("mcp__"), t, F.lit("__run"))).when(k == 1, F.concat(F.lit("mcp:"), t, F.lit(":run"))).when(k == 2, F.concat(F.lit("mcp:"), t)).otherwise(t)
    return chatlog.with_tier(table(spark, sf_dir, "events").select(name.alias("tool")), tiers=tiers).groupBy("tool", "tool_source", "trust_tier").agg(F.count("*").alias("n"))


TOOL_TIERS = """WITH e AS (SELECT event_type AS t, event_id % 4 AS k FROM events),
f AS (SELECT CASE k WHEN 0 THEN 'mcp__' || t || '__run' WHEN 1 THEN 'mcp:' || t || ':run' WHEN 2 THEN 'mcp:' || t ELSE t END AS tool, CASE WHEN k = 3 AND t = 'click' THEN 'click' WHEN k < 3 AND t IN ('view', 'signup') THEN 'mcp:' || t END AS tool_source FROM e)
SELECT tool, tool_source, CASE tool_source WHEN 'click' THEN 'repo_source' WHEN 'mcp:view' THEN 'untrusted_web' ELSE 'semi_trusted_service' END AS trust_tier, count(*) AS n FROM f WHERE tool_source IS NOT NULL GROUP BY ALL"""


def bounded_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlog.bounded_counter(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


BOUNDED_USERS = """WITH u AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY min((ts, event_id)), user_id) AS k FROM events GROUP BY user_id)
SELECT CASE WHEN k <= 32 THEN user_id::VARCHAR ELSE '__other__' END AS bucket, sum(n)::BIGINT AS n FROM u GROUP BY ALL"""


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rollup(table(spark, sf_dir, "events").withColumn("amount", F.get_json_object("props", "$.k").cast("long")), ["event_type"], "amount")


USAGE_ROLLUP = "SELECT event_type, count(*) AS events, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.k') AS known FROM events GROUP BY event_type"


def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.last_write(table(spark, sf_dir, "events"), ["user_id"], ["event_type", "props"], "event_id")


LAST_WRITE = "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id"

# -- rules and containment -------------------------------------------------------------------------------------------

STEMS = (("Th-thin", "thin"), ("erer", "er"), ("ntion", "tion"), ("queque", "que"), ("schund", "sch"), ("cion", "tion"), (" ", "none"))


def stem_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stem_hits(table(spark, sf_dir, "documents"), STEMS).select("doc_id", F.array_join("hits", ",").alias("hits")).where("hits <> ''")


SQL_TAG = r"trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-')"
STEM_HITS = f"""WITH n AS (SELECT doc_id, {SQL_TAG.format("nfkc(text)")} AS t FROM (SELECT doc_id, text FROM documents)),
v(stem, tag) AS (VALUES {', '.join(f"('{a.strip()}', '{b}')" for a, b in STEMS if a.strip())}),
h AS (SELECT DISTINCT doc_id, tag FROM n JOIN v ON contains(t, {SQL_TAG.format('stem')}))
SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS hits FROM h GROUP BY doc_id""".replace("nfkc(text)", "text")


def tier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").withColumn("label", F.regexp_replace("o_orderpriority", r"^\d-", ""))
    admitted = rules.admit(own, "label", ["low", "not-specified", "medium", "high", "urgent"], F.when(F.col("o_orderstatus") == "F", "medium").otherwise("high"))
    return admitted.groupBy("custody", "admitted", "reason").agg(F.count("*").alias("n"))


TIER_RANK = """WITH a AS (SELECT replace(trim(lower(regexp_replace(o_orderpriority, '^\\d-', ''))), '_', '-') AS l, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 4 END AS need FROM orders),
b AS (SELECT replace(l, ' ', ' ') AS l, need, list_position(['low', 'not-specified', 'medium', 'high', 'urgent'], l) AS r FROM a)
SELECT CASE WHEN r > 0 THEN l END AS custody, coalesce(r >= need, FALSE) AS admitted, CASE WHEN r IS NULL OR r = 0 THEN 'unknown-label' WHEN r < need THEN 'below-required' END AS reason, count(*) AS n FROM b GROUP BY ALL"""


def benchmark_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims held whole in a text, as containment checks of provenance do; the first eight words are the join's key."""
    return rules.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


BENCHMARK_CONTAINED = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def short_claims_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for claims of one to seven words: the first words of benchmark items."""
    items = table(spark, sf_dir, "benchmark").withColumn("text", F.expr("array_join(slice(split(text, ' '), 1, cast(item_id % 7 + 1 as int)), ' ')"))
    return rules.contained(documents(spark, sf_dir), items).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


SHORT_CLAIMS_CONTAINED = """SELECT item_id, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents d JOIN (SELECT item_id, array_to_string(string_split(text, ' ')[1:item_id % 7 + 1], ' ') AS claim FROM benchmark) b ON contains(d.text, claim) GROUP BY item_id"""

_ALL = (token_profile, redacted_documents, findings_by_pattern, line_classes, source_cards, summary_sections, run_overview, claim_recall, authoritative_recall, savings_gate, handoff_choice, cohort_stats, cohort_few, cohort_rates, corpus_digests, repeated_texts, document_rules, toon_nations, chat_answers, ordered_correlation, unordered_correlation, first_turns, truncated_turns, tool_tiers, bounded_users, usage_rollup, last_write, stem_hits, tier_rank, benchmark_contained, short_claims_contained)

QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {name: sql for name in QUERIES if (sql := globals().get(name.upper()))}
