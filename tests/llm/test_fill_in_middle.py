"""Fill-in-the-middle rows against a plain version, and the unit grammars."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sedge.llm import fill_in_middle as M

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, rate=50, spm=80):
    text = text or ""
    u = TOKENS.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(u), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


TEXTS = ["", None, " ", "\t\n ", "one", " one", "one ", " a  b\n\nc\t", "😀 é́ 東京 x \U0001F600", "a <P> b", "a < P> b<", "<S>", "<M>", "<", "P>x<", "x\x00y z", "\x1c\x85 \xa0", "word " * 40_000, "y" * 300_000, "l1\nl2\r\nl3\n"]


def test_against_a_plain_version(spark):
    rows = [(i * 7 + j, t) for i, t in enumerate(TEXTS) for j in range(1, 40)] + [(3, "same id, one text"), (3, "same id, another"), (3, "same id, another"), (None, "no id at all here"), (None, None), (-5, "below zero is an id too")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, form string, _u int").repartition(3)
    out = M.transform(df)
    assert out.columns == ["doc_id", "text", "_u", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted(((r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in out.collect()), key=str)
    assert got == sorted(((d, t, plain(d, t), t or "") for d, t in rows), key=str)
    assert {g[2][1] for g in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize(("rate", "spm"), [(0, 80), (100, 0), (100, 100)])
def test_rates(spark, rate, spm):
    rows = [(i, f"some words {i} in it") for i in range(50)]
    got = M.transform(spark.createDataFrame(rows, "doc_id long, text string"), rate=rate, spm=spm).collect()
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in sorted(got)] == [plain(d, t, rate, spm) for d, t in rows]


@pytest.mark.parametrize(("grammar", "pattern"), [("token", TOKENS.pattern), ("word", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("line", r"[^\n]*\n|[^\n]+"), ("character", r"(?s:.)")])
def test_units_join_up_to_the_text(spark, grammar, pattern):
    texts = [t for t in TEXTS if t is not None and len(t) < 300_000] + ["\n", "\n\n", "a\n", "\na"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.units(F.col("t"), grammar).alias("u")).collect()
    for r in got:
        assert r.u == re.findall(pattern, r.t) and "".join(r.u) == r.t


def test_empty_table_and_plan(spark):
    out = M.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == [] and out.columns[2:] == ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
