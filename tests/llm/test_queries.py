"""The registered queries themselves on a small folder of odd rows, against plain loops or DuckDB."""

import hashlib
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from sedge.llm import registry
from tests.llm.test_dedup import linked
from tests.llm.test_text_operators import REFERENCE

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"word{i}" for i in range(60))
    texts = ["A line that repeats here\nx", "  a LINE that repeats here\t\ny", passage, f"in front {passage} behind", "", None, "MIT License; cc by", "ééé ÄÖ 東京 12", "x " * 9000, passage, "no letters: 12 34", "idiot moron trash scum", "the benchmark item number one stands here in full"]
    texts += [f"words of document {i} and no more than that" for i in range(40)] + ["idiot moron pathetic " + str(i) for i in range(20)]
    rows = [(7 * i, t, ["en", "fr", None][i % 3], "s", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    marks = [(d, 1, int("idiot" in (t or ""))) for d, t, *_ in rows] + [(None, 0, 1), (7, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "The benchmark item, number one: stands here."), (2, None), (3, "absent")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, "http://A.Example.org/es/x?q", ""), (2, None, ""), (3, "nothing", None), (4, "x://casino.net/", ""), (4, "x://casino.net/", "")], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(45)] + [(60, None)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at, rows


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def rows_of(spark, name, at):
    df = registry.QUERIES[name](spark, at)
    return df, {r.doc_id: r for r in df.collect()} if "doc_id" in df.columns else df.collect()


def test_op1_and_op2_and_op8_as_their_sql(spark, folder):
    at, rows = folder
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    for name in ("op1_line_dedup", "op2_substring_dedup", "op8_url_filter"):
        df = registry.QUERIES[name](spark, at)
        want = con.sql(registry.ORACLE[name])
        own = df.select(*want.columns)
        assert sorted(map(tuple, own.collect()), key=str) == sorted(want.fetchall(), key=str), name
        assert own.count() == (5 if name == "op8_url_filter" else len(rows))


def test_op3(spark, folder):
    at, rows = folder
    prints = []
    for _, t, *_ in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = linked(prints, 4)
    _, got = rows_of(spark, "op3_simhash", at)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{p:016x}", rows[g][0]) for (d, *_), p, g in zip(rows, prints, group, strict=True)}


def test_op4(spark, folder):
    at, rows = folder
    df, got = rows_of(spark, "op4_licenses", at)
    assert df.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        assert got[d].n_words == len(w) and 0 <= got[d].score <= 1
    assert (got[42].n_base, got[42].first_word, got[42].last_word, got[42].base_labels) == (2, 0, 2, "cc-by,mit")


def test_op5(spark, folder):
    at, _ = folder
    assert [(r.doc_id, r.item_id, r.distance) for r in registry.op5_decontamination(spark, at).collect()] == [(84, 1, 0)]


@pytest.mark.parametrize(("name", "by", "rest"), [("op6_toxicity", 5, 0), ("op7_language", 4, 2)])
def test_held_out_columns(spark, folder, name, by, rest):
    at, rows = folder
    df, got = rows_of(spark, name, at)
    assert len(got) == len(rows)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % by == rest) and 0 <= r.score <= 1
    if name == "op6_toxicity":
        assert all(r.predicted == int(r.score >= 0.5) for r in got.values()) and dict(df.dtypes)["predicted"] == "int"
        assert sum(r.predicted for r in got.values()) >= 18
    else:
        assert {d for d, r in got.items() if r.lang_pred == "und"} == {d for d, t, *_ in rows if not any(c.isalpha() for c in t or "")}
        assert {r.lang_pred for r in got.values()} <= {"en", "fr", "und"}


def test_held_out_labels_and_languages_are_not_learned_from(spark, folder, tmp_path):
    at, _ = folder
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{at}/{t}.parquet")
        if t == "labels":
            df = df.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
        else:
            df = df.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang", "'other' as source", "n_chars")
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op6_toxicity", "op7_language"):
        assert rows_of(spark, name, at)[1] == rows_of(spark, name, str(tmp_path))[1]


def test_op9(spark, folder):
    at, _ = folder
    x = np.array([[i % 5, 1, i % 3] for i in range(45)], float)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in registry.op9_ann(spark, at).collect()}
    for q in (0, 20, 40):
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(45), -s)) if i != q][:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, s[i]) for i in order]
    assert len(got) == 60


def test_op10(spark, folder):
    at, rows = folder
    _, got = rows_of(spark, "op10_byte_bpe", at)
    for d, t, *_ in rows:
        ids = REFERENCE.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t or ""))


def test_op11_op12_and_op13_as_their_sql(spark, folder):
    at, rows = folder
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    for name in ("op11_collocations", "op12_fill_in_middle", "op13_topk"):
        df = registry.QUERIES[name](spark, at)
        want = con.sql(registry.ORACLE[name])
        got = sorted(map(tuple, df.select(*want.columns).collect()), key=str)
        assert got and got == sorted(want.fetchall(), key=str), name
