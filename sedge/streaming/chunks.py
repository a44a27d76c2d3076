"""Raw chunks of event streams: rows (stream_id, seq, chunk), cut anywhere, even inside a character or a line's end.

In a stream, keyed state holds what of an event is there so far: bytes of an unfinished line, its data, whether a carriage
return came last. Memory for a stream is bounded by the bounds on a line and an event: from there on bytes are only passed
over. In a batch, the chunks of a stream are put together and framed as one text. Both give the same events.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sedge.functions.spread import dealt
from sedge.streaming import sse

#: Stands for data that is no UTF-8: no JSON, it voids its stream.
UNREADABLE = "(no utf-8)"
EVENTS = "stream_id string, pos long, event string, data string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chunk_frames(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(key, pos, event, data): the events of :func:`sse.frames` out of chunks (binary) put together by ``seq``.

    A chunk that comes twice counts once (of different ones the greatest by bytes); null chunks are empty; rows without a key or a ``seq`` are passed over. Bytes
    are framed before they are read as UTF-8, so an event whose data is none comes as UNREADABLE and leaves others alone.
    """
    own = dealt(chunks.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(key, F.col(seq).alias("_s"), F.col(chunk).alias("_c")), key)
    # all of a stream meets once, and what comes twice is told apart there: rows are sorted for one grouping only
    parts = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_s", F.coalesce(F.decode("_c", "ISO-8859-1"), F.lit("")).alias("t")))).alias("_p"))
    once = F.filter("_p", lambda x, i: ~F.coalesce(x["_s"] == F.get("_p", i + 1)["_s"], F.lit(False)))
    texts = parts.select(key, F.array_join(F.transform(once, lambda x: x.t), "").alias("_text"))
    framed = sse.frames(texts, key, "_text", size=F.length)  # a character a byte
    data = F.encode("data", "ISO-8859-1").cast("string")
    return framed.select(key, F.col("pos").cast("long").alias("pos"), F.make_valid_utf8(F.encode("event", "ISO-8859-1").cast("string")).alias("event"), F.when(F.is_valid_utf8(data), data).otherwise(UNREADABLE).alias("data"))


class Frame:
    """The event of a stream that is not finished yet."""

    FIELDS = "line binary, cr boolean, event binary, data binary, has boolean, some boolean, over boolean, lead int, pos long, seq long"

    def __init__(self, state: tuple | None = None):
        self.line, self.cr, self.event, data, has, self.some, self.over, self.lead, self.pos, self.seq = state or (b"", False, None, b"", False, False, False, 0, 0, None)
        self.parts = [bytes(data)] if has else []
        self.size = len(data) if has else -1

    def state(self) -> tuple:
        return bytes(self.line), self.cr, self.event, b"\n".join(self.parts), bool(self.parts), self.some, self.over, self.lead, self.pos, self.seq

    def feed(self, chunk: bytes) -> Iterator[tuple[int, str | None, str]]:
        """The events (pos, event, data) that a chunk ends."""
        if self.cr and chunk[:1] == b"\n":  # the other half of a line's end
            chunk, self.cr = chunk[1:], False
        if chunk:
            self.cr = chunk.endswith(b"\r")
        first, *more = chunk.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        self.line = bytes(self.line) + first
        for line in more:
            yield from self._ended()
            self.line = line
        if len(self.line) > sse.MAX_LINE:  # its rest is passed over
            self.over, self.some, self.line = True, True, self.line[:1]

    def _ended(self) -> Iterator[tuple[int, str | None, str]]:
        line = bytes(self.line)
        if not line:
            if self.some:
                if self.over or self.size > 0:
                    yield self.pos, None if self.over or self.event is None else bytes(self.event).decode("utf-8", "replace"), self._data()
                self.event, self.parts, self.size, self.some, self.over = None, [], -1, False, False
                self.pos += 1
            elif self.pos == 0:  # blank lines before the first event
                self.lead += 1
                self.pos = int(self.lead == 2)
            return
        self.some = True
        self.over = self.over or len(line) > sse.MAX_LINE
        if line.startswith(b"data:") and not self.over:
            value = line[5:].removeprefix(b" ")
            self.parts.append(value)
            self.size += len(value) + 1
            if self.size > sse.MAX_EVENT:
                self.over, self.parts, self.size = True, [], -1
        elif line.startswith(b"event:") and self.event is None:
            self.event = line[6:].removeprefix(b" ")

    def _data(self) -> str:
        if self.over:
            return sse.OVERSIZE
        try:
            return b"\n".join(self.parts).decode()
        except UnicodeDecodeError:
            return UNREADABLE


def _in_order(rows: Iterable[pd.DataFrame], after: int | None) -> Iterator[tuple[int, bytes]]:
    """(seq, chunk) of a micro-batch by ``seq``; what came before is passed over."""
    whole = pd.concat(list(rows))
    for seq, chunk in whole[whole["seq"].notna()].sort_values("seq", kind="stable")[["seq", "chunk"]].itertuples(index=False):
        if after is None or seq > after:
            after = int(seq)
            yield after, b"" if chunk is None else bytes(chunk)


class Framing(StatefulProcessor):
    """Chunks of a key in, whole events out. State goes when a stream has been silent for ``timeout_ms``."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", Frame.FIELDS)

    def frame(self) -> Frame:
        return Frame(self.open.get() if self.open.exists() else None)

    def _wait(self, timers) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def _events(self, frame: Frame, rows) -> Iterator[tuple[int, str | None, str]]:
        for frame.seq, chunk in _in_order(rows, frame.seq):
            yield from frame.feed(chunk)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = self.frame()
        events = list(self._events(frame, rows))
        self.open.update(frame.state())
        self._wait(timerValues)
        if events:
            pos, event, data = zip(*events, strict=True)
            yield pd.DataFrame({"stream_id": [key[0]] * len(pos), "pos": pos, "event": pd.Series(event, dtype=object), "data": data})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


class Answering(Framing):
    """Chunks of a key in, one report out: when its stream stops, or as unavailable when it has been silent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.folded = handle.getValueState("folded", "fold string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.folded.get()[0]) if self.folded.exists() else dict(sse.EMPTY)
        if "closed" not in s:  # a stream that was reported needs no more than a mark
            frame = self.frame()
            for _, _, data in self._events(frame, rows):
                s = sse.step(s, data)
            if s["phase"] == 3:
                yield sse.report(key[0], s)
                s = sse.CLOSED
                self.open.clear()
            else:
                self.open.update(frame.state())
            self.folded.update((json.dumps(s),))
        self._wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = json.loads(self.folded.get()[0]) if self.folded.exists() else dict(sse.CLOSED)
        self.open.clear()
        self.folded.clear()
        if "closed" not in s:
            yield sse.report(key[0], s | {"bad": True})


def _keyed(chunks: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    spark: SparkSession = chunks.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    own = chunks.where("stream_id is not null").select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk")
    return own.groupBy("stream_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def stream_frames(chunks: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """A streaming DataFrame of events (stream_id, pos, event, data) out of one of chunks (stream_id, seq, chunk).

    Chunks of a stream must come in order from one micro-batch to the next; within one they are sorted, and one that comes
    again is passed over. An event leaves with the micro-batch that ends it; the state goes after ``timeout_ms`` of silence.
    """
    return _keyed(chunks, Framing(timeout_ms), EVENTS)


def chunk_telemetry(chunks: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """A streaming DataFrame of the reports of :func:`sse.stream_telemetry` out of chunks, framed and folded in one state."""
    return _keyed(chunks, Answering(timeout_ms), sse.REPORT)
