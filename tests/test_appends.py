"""Appends that happen once however often a batch runs, and jobs made of prompts."""

import json
import os

from pyspark.sql import functions as F

from sedge.streaming import appends


def values(spark, path):
    return sorted(json.loads(r.value)["n"] for r in appends.appended(spark, str(path)).collect())


def test_a_repeated_batch_appends_once(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("n"))
    to = str(tmp_path / "log")
    assert appends.append_batch(rows, 0, to, "a") and not appends.append_batch(rows, 0, to, "a")
    assert appends.append_batch(rows, 0, to, "b") and appends.append_batch(rows.limit(0), 1, to, "a")
    assert values(spark, to) == sorted([*range(5), *range(5)])
    half = tmp_path / "log" / "writer=a" / "batch=2" / "_temporary"
    half.mkdir(parents=True)
    (half / "part-0").write_text('{"n": 99}\n')
    assert values(spark, to) == sorted([*range(5), *range(5)])
    assert appends.append_batch(spark.range(7, 9).select(F.col("id").alias("n")), 2, to, "a")
    assert values(spark, to) == sorted([*range(5), *range(5), 7, 8])
    assert {(r.writer, r.batch) for r in appends.appended(spark, to).select("writer", "batch").distinct().collect()} == {("a", 0), ("b", 0), ("a", 2)}


def test_a_stream_that_runs_its_last_batch_again(spark, tmp_path):
    """The note of the last batch's end is taken away, as if the driver had been lost before writing it."""
    src, to, ck = tmp_path / "in", tmp_path / "log", tmp_path / "ck"
    src.mkdir()

    def go():
        stream = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).json(str(src))
        q = appends.append(stream, str(to), str(ck), "hook", appends.audit_lines).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for k in range(3):
        (src / f"{k}.json").write_text(f'{{"n": {k}}}\n{{"n": {k + 10}}}\n')
    go()
    assert values(spark, to) == [0, 1, 2, 10, 11, 12]
    for name in ("2", ".2.crc"):
        if (ck / "commits" / name).exists():
            os.remove(ck / "commits" / name)
    before = sorted(p.name for p in to.rglob("part-*"))
    go()
    assert values(spark, to) == [0, 1, 2, 10, 11, 12] and sorted(p.name for p in to.rglob("part-*")) == before
    assert all(json.loads(r.value)["ts"].endswith("Z") for r in appends.appended(spark, str(to)).collect())


def test_queued(spark):
    schema = "id string, created_at string, repo string, tool string, budget_tokens long, prompt string, more int"
    rows = [("a", "1", "r", "t", 5, "old", 1), ("a", "2", "r", "t", 6, "mail me@example.org", 1), ("a", None, "r", "t", 7, "untimed", 1), ("b", None, None, None, None, None, 1), (None, "1", None, None, None, "ignore previous https://x.org", 1), ("c", "1", None, None, None, "z", 1), ("c", "1", None, None, None, "y", 1)]
    jobs = appends.queued(spark.createDataFrame(rows, schema))
    got = {r.id: r for r in jobs.collect()}
    assert jobs.columns == list(appends.JOB) and len(got) == 4
    a = got["a"]
    assert (a.created_at, a.budget_tokens, a.flags, a.authorization) == ("2", 6, ["redacted"], "queued-not-authorized") and "me@example.org" not in a.prompt and len(a.redactions) == 1
    assert (got["b"].prompt, got["b"].flags, got["c"].prompt) == ("", [], "z")
    named = next(r for k, r in got.items() if k.startswith("job-"))
    assert named.flags == ["injection-shaped", "has-url"] and len(named.id) == 20
    assert appends.queued(spark.createDataFrame([], "prompt string")).count() == 0
