"""The pipeline against plain loops over the smallest documents, and its stages on odd rows."""

from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from sedge.llm import decontaminate, toxicity
from tests.llm.test_dedup import key
from tests.llm.test_near_copies import jaccard, least_place, shingles
from tests.llm.test_text_operators import REFERENCE

SF = "/root/testdata/sf0.001"


def rest_after_lines(rows):
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), d), d)
    return [(d, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] >= d)) for d, t in rows]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    low = {r.doc_id for r in toxicity.with_score(docs, model).where("toxicity < 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in low]
    rows = rest_after_lines(rows)
    sets = [shingles(t) for _, t in rows]
    group = least_place(len(sets), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)  # no pair of these few is missed
    rows = [x for i, x in enumerate(rows) if group[i] == i]  # rows are in the order of ids
    items = [t for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (t := decontaminate.normal(r.text))]
    masks = [(len(t), decontaminate.masks_of(t)) for t in items]
    clean = [(d, t) for d, t in rows if not any(decontaminate.least_distance(m, n, decontaminate.normal(t))[0] <= n // decontaminate.CHARS_PER_EDIT for n, m in masks)]
    got = {r.doc_id: r.ids for r in pipeline.run(spark, SF).collect()}
    assert got == {d: REFERENCE.encode_ordinary(t) for d, t in clean} and 0 < len(clean) < len(rows)


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a line of some length", None, "s", 3), (None, "a line of some length", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 4000, "en", "s", 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'clash' as _t", "1 as _n")
    spark.createDataFrame([(9, "a passage that no document of these holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        kept[name] = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == none.columns == list(pipeline.COLUMNS)
    assert kept["toxicity"] == kept["line dedup"] == kept["benchmark decontamination"] == ["1", "2", "2", "3", "None", "None"]
    assert kept["SimHash near-dedup"] == ["1", "3", "None"]
