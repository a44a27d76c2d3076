"""Raw chunks cut anywhere: the keyed form, the batch form and whole texts must give the same events."""

import json
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.streaming import chunks as C
from sedge.streaming import sse
from tests.test_streams import good

PIECES = ["data: {}\n", "data:x\r\n", "data:  é東😀\r", "event: e\n", "event:second\n", ": note\n", "\n", "\r\n", "\r", "\n\n", "\r\r", "id: 3\n", "data\n", "data:\n", "data: " + "y" * 40 + "\n", "data: unfinished"]


def cut(data: bytes, rng: random.Random) -> list[bytes]:
    places = sorted(rng.sample(range(len(data) + 1), min(len(data) + 1, rng.randint(0, 12))))
    return [data[i:j] for i, j in zip([0, *places], [*places, len(data)], strict=True)]


def folded(parts):
    """Each chunk through a state that is stored and read again."""
    state, out = None, []
    for p in parts:
        frame = C.Frame(state)
        out += frame.feed(p)
        state = frame.state()
    return out


def plain(text: str, most_line: int, most_event: int):
    """Line by line over the whole text."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")[:-1]
    out, event, data, own = [], None, [], []
    pos = 1 if lines[:2] == ["", ""] else 0
    for line in lines:
        if line:
            own.append(line)
        elif own:
            event = next((x[6:].removeprefix(" ") for x in own if x.startswith("event:")), None)
            data = "\n".join(x[5:].removeprefix(" ") for x in own if x.startswith("data:"))
            if any(len(x.encode()) > most_line for x in own) or len(data.encode()) > most_event:
                out.append((pos, None, sse.OVERSIZE))
            elif data:
                out.append((pos, event, data))
            pos, own = pos + 1, []
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.integers(0, 10**6))
def test_any_cut_gives_the_events_of_the_whole(pieces, seed):
    text = "".join(pieces)
    line, event = sse.MAX_LINE, sse.MAX_EVENT
    try:
        for sse.MAX_LINE, sse.MAX_EVENT in ((1000, 1000), (30, 1000), (1000, 60)):
            assert folded(cut(text.encode(), random.Random(seed))) == plain(text, sse.MAX_LINE, sse.MAX_EVENT)
    finally:
        sse.MAX_LINE, sse.MAX_EVENT = line, event


def test_state_stays_small_within_a_line_that_never_ends():
    state = None
    for _ in range(40):
        frame = C.Frame(state)
        assert list(frame.feed(b"data: " + b"x" * 100_000)) == []
        state = frame.state()
    assert sum(len(x) for x in state if isinstance(x, bytes)) <= sse.MAX_LINE
    frame = C.Frame(state)
    assert list(frame.feed(b"\n\ndata: 1\n\n")) == [(0, None, sse.OVERSIZE), (1, None, "1")]


def texts(n=60):
    rng = random.Random(11)
    out = {f"t{i}": "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for i in range(n)}
    out["answer"] = "".join(f"event: {v['type']}\ndata: {json.dumps(v)}\r\n\r\n" for v in good())
    return out


def rows_of(all_texts, seed=1):
    rng = random.Random(seed)
    return [(k, i, bytearray(p)) for k, t in all_texts.items() for i, p in enumerate(cut(t.encode(), rng))]


def test_batch_form(spark):
    own = texts()
    rows = rows_of(own)
    twice = rows + rows[::3] + [(None, 0, bytearray(b"data: 1\n\n")), ("t0", None, bytearray(b"data: 1\n\n"))]
    random.Random(2).shuffle(twice)
    bad = [("bad", 0, bytearray(b"data: 1\n\ndata: \xe6\x9d")), ("bad", 1, bytearray(b"\n\nevent: \xff\ndata: 2\n\n")), ("none", 0, None), ("none", 1, bytearray(b"data: 3\n\n"))]
    got = C.chunk_frames(spark.createDataFrame(twice + bad, "stream_id string, seq int, chunk binary").repartition(5))
    assert got.dtypes == [("stream_id", "string"), ("pos", "bigint"), ("event", "string"), ("data", "string")]
    whole = sse.frames(spark.createDataFrame(list(own.items()), "stream_id string, text string"))
    want = [tuple(r) for r in whole.collect()] + [("bad", 0, None, "1"), ("bad", 1, None, C.UNREADABLE), ("bad", 2, "�", "2"), ("none", 0, None, "3")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    for k, t in own.items():
        assert [(r[1], r[2], r[3]) for r in sorted(want, key=str) if r[0] == k] == sorted(plain(t, sse.MAX_LINE, sse.MAX_EVENT), key=str)


def test_streams_are_dealt_out_however_few_bytes_they_take_on_disk(spark):
    """Chunks that are alike take next to nothing on disk, so partitions joined by their bytes would be one task's."""
    same = spark.range(2000).select((F.col("id") % 100).cast("string").alias("stream_id"), F.floor(F.col("id") / 100).alias("seq"), F.lit(b"data: 1\n\n").alias("chunk"))
    got = C.chunk_frames(same)
    assert got.rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism and got.count() == 2000


def test_of_chunks_under_one_number_the_greatest_counts(spark):
    rows = [("a", 0, bytearray(b"data: 1\n\n")), ("a", 0, None), ("a", 0, bytearray(b"data: 2\n\n")), ("a", 1, bytearray(b"data: \xc3\xa9\n\n")), ("a", 1, bytearray(b"data: z\n\n"))]
    for order in (rows, rows[::-1]):
        assert [r.data for r in C.chunk_frames(spark.createDataFrame(order, "stream_id string, seq int, chunk binary")).orderBy("pos").collect()] == ["2", "é"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, C.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def streamed(spark, tmp_path, batches, schema, start, wanted):
    """The rows of a query over one file of JSON lines a micro-batch, once ``wanted`` of them are there."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    stream = spark.readStream.schema("stream_id string, seq long, hex string").option("maxFilesPerTrigger", 1).json(str(src))
    made = start(stream.select("stream_id", "seq", F.unhex("hex").alias("chunk")))
    q = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    read = lambda: [tuple(r) for r in spark.read.schema(schema).parquet(str(out)).collect()] if out.exists() else []
    try:
        until = time.time() + 120
        for n, rows in enumerate(batches):
            (tmp_path / "x").write_text("".join(json.dumps({"stream_id": k, "seq": i, "hex": bytes(p).hex()}) + "\n" for k, i, p in rows))
            os.utime(tmp_path / "x", (1_000_000 + n, 1_000_000 + n))  # files are read in order of age
            (tmp_path / "x").rename(src / f"{n}.json")
        while time.time() < until and q.isActive and len(read()) < wanted:
            time.sleep(0.5)
        assert q.exception() is None
    finally:
        q.stop()
    return read()


def test_stream_of_chunks(rocks, tmp_path):
    """Three micro-batches, the second of which repeats what the first brought: the events of the whole texts, once."""
    own = texts(12)
    rows = rows_of(own)
    batches = [[r for r in rows if r[1] < 4], [r for r in rows if r[1] < 8], [r for r in rows if r[1] >= 8]]
    want = sorted(((k, *e) for k, t in own.items() for e in plain(t, sse.MAX_LINE, sse.MAX_EVENT)), key=str)
    assert sorted(streamed(rocks, tmp_path, batches, C.EVENTS, C.stream_frames, len(want)), key=str) == want


def test_stream_of_answers_in_chunks(rocks, tmp_path):
    """One answer is whole, one falls silent, one is void: each is reported once."""
    data = texts(0)["answer"].encode()
    rows = [("whole", i, data[i * 40:(i + 1) * 40]) for i in range(len(data) // 40 + 1)] + [("silent", 0, data[:200])] + [("void", i, p) for i, p in enumerate([data[:-30], b"data: [1]\n\n", data[-30:]])]
    got = streamed(rocks, tmp_path, [rows[:5], rows[5:]], sse.REPORT, lambda c: C.chunk_telemetry(c, timeout_ms=4000), 3)
    assert sorted((r[0], r[1], r[3], r[7]) for r in got) == [("silent", False, None, None), ("void", False, None, None), ("whole", True, "m", 7)]


def test_another_state_store_is_refused(spark):
    with pytest.raises(ValueError, match="providerClass"):
        C.stream_frames(spark.createDataFrame([], "stream_id string, seq long, chunk binary"))
