"""A corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, documents with
benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Columns beyond those of ``documents`` are let go by the first stage. Every stage takes texts whole, however
long, gives an empty table for an empty one, and treats null texts as empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from sedge.llm.common import removed, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; null and empty texts stay, as the score of each row is its text's own."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; every document stays, even if its text is now empty."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies; all empty texts are one component.

    Shingles are five words. Two texts link whose sets of shingles are the same or have a similarity (Jaccard) of 0.8 or
    more, counted exactly. Candidates are pairs that meet at an anchor of one of three fingerprints and differ in at most
    40 of all 192 bits; a similarity of 0.8 differs in 29 bits on average. Rows that repeat an id and a text are one
    document; components of null ids alone keep one row too. Texts of any length are taken whole.
    """
    found = near_copies.near_copies(docs, size=5, distance=8, tables=3, total=40, least=0.8)
    first = found.where("doc_id <=> component_id").groupBy("root").agg(F.min(F.struct("doc_id", "txt")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("_id"), F.col("k.txt").alias("_txt"))
    rows = docs.select(*COLUMNS).withColumn("_t", F.xxhash64("text"))
    left = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_txt")))
    once = Window.partitionBy("doc_id", "_t").orderBy("lang", "source", "n_chars")
    return left.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; rows with null ids are judged as any other."""
    items = table(spark, sf_dir, "benchmark")
    return decontaminate.without_leaks(docs.select(*COLUMNS), items).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its id, the number of tokens, digests of the ids and of the text decoded from them, and the ids."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot say the scoring, fingerprinting and encoding stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. A stage's rows are deleted once the
    next one's are written; the last stage's input, which the result still reads, stays under ``pipeline-*``."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{n}")
        docs = spark.read.parquet(f"{at}/{n}")
        if n:
            removed(spark, f"{at}/{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
