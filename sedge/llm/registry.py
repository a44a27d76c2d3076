"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import ann, bpe, collocations, decontaminate, fill_in_middle, language, licenses, line_dedup, simhash, substring_dedup, topk, toxicity, url_filter
from sedge.llm.common import spread, table


def texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents for work that is dear by the row: a file of one row group is dealt out to all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, seed=42, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(texts(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string")) % by


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    scored = toxicity.with_score(docs, model).withColumnRenamed("toxicity", "score")
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "lang")
    model = language.fit(docs.where(remainder(4) != 2).select("text", "lang"))
    found = language.label(docs.select("doc_id", "text"), model, with_spans=False)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(texts(spark, sf_dir), keep_ids=False).drop("text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_simhash, op4_licenses, op5_decontamination, op6_toxicity, op7_language, op8_url_filter, op9_ann, op10_byte_bpe, op11_collocations, op12_fill_in_middle, op13_topk)}

OP1 = r"""WITH l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT key, min(doc_id) AS least FROM l WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT doc_id, i, line, coalesce(doc_id > least, FALSE) AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id"""

OP2 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
b AS (SELECT doc_id, i, 1 AS bad FROM w JOIN f USING (k) WHERE doc_id > least),
x AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
y AS (SELECT doc_id, i, word, coalesce(max(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING), 0) AS gone FROM x LEFT JOIN b USING (doc_id, i)),
z AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN z USING (doc_id)"""

ORACLE = {"op1_line_dedup": OP1, "op2_substring_dedup": OP2, "op8_url_filter": url_filter.oracle(), "op11_collocations": collocations.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE, "op13_topk": topk.ORACLE}
