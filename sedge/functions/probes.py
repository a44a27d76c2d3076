"""Keys by which texts and what they hold meet: hashes of whole inner words or of first bytes, worked out in Arrow's buffers.

An item of three words and more has a key of the inner ones of its first words, any other of its first bytes. A text has one
of each place where such a key may stand. Hashes are differences of prefix sums, so each costs the same however long its
part is. What items have is a bitmap of bounded size beside which keys of texts are laid before they travel: an odd key costs
a row, never a result, as keys only propose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: How many first bytes make a key, bytes of texts that are worked on at a time, and bits of the bitmap (2 ** n) at most: 8 MB.
HEADS, STEP, MOST = (1, 2, 3, 6), 1 << 20, 26
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.cumprod(np.full(256, np.uint64(0xBF58476D1CE4E5B9))) ^ np.cumprod(np.full(256, np.uint64(0x94D049BB133111EB))) >> np.uint64(31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base)])


def _seed(kind: int) -> np.uint64:
    return np.uint64((kind + 64) * 0x2545F4914F6CDD1D & (1 << 64) - 1)


class _Hashes:
    """Hashes of parts of a buffer; equal parts have equal ones wherever they stand."""

    _up = _down = np.ones(1, "u8")

    def __init__(self, data: np.ndarray):
        if len(data) >= len(_Hashes._up):
            _Hashes._up, _Hashes._down = (_powers(b, max(len(data), STEP)) for b in (_BASE, _INVERSE))
        self.sums = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * self._up[: len(data)])]

    def of(self, first: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        return ((self.sums[end] - self.sums[first]) * self._down[first] + _seed(kind)) * _SPREAD

    def heads(self, m: int) -> np.ndarray:
        n = len(self.sums) - m
        return ((self.sums[m:] - self.sums[:-m]) * self._down[: max(n, 0)] + _seed(-m)) * _SPREAD if n > 0 else np.zeros(0, "u8")


def _hits(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))


def _places(data: np.ndarray, at: np.ndarray, kinds: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of the texts data[at[i]:at[i + 1]], each pair once, so far as the bitmap has the key."""
    hashes, spaces = _Hashes(data), np.flatnonzero(data == 32)
    rows, keys = [np.zeros(0, "i8")], [np.zeros(0, "u8")]
    for kind in kinds:
        if kind > 0:
            first, end = spaces[: -(kind - 2)], spaces[kind - 2 :]
            own = hashes.of(first + 1, end, kind)
            hit = _hits(own, bits)
            first, end, own = first[hit], end[hit], own[hit]
        else:
            own = hashes.heads(-kind)
            first = _hits(own, bits)
            end, own = first - kind, own[first]
        row = np.searchsorted(at, first, "right") - 1
        inside = (end <= at[row + 1]) if kind < 0 else (end < at[row + 1])
        rows.append(row[inside])
        keys.append(own[inside])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])][: len(row)]
    return row[new], key[new]


def item_keys(items: DataFrame, words: int) -> DataFrame:
    """(item_id, _kind, _k) of items (item_id, text), none of them null or empty: ``_kind`` is the number of words looked at,
    or that of first bytes, negative."""

    def one(text: bytes) -> tuple[int, int]:
        split = text.split(b" ", words)
        n = min(len(split), words)
        kind = n if n > 2 else -max(m for m in HEADS if m <= len(text))
        part = np.frombuffer(b" ".join(split[1 : n - 1]) if n > 2 else text[:-kind], "u1")
        return kind, int(_Hashes(part).of(np.array([0]), np.array([len(part)]), kind).view("i8")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column("item_id"), pa.array([k for k, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int64())], ["item_id", "_kind", "_k"])

    kind = items.schema["item_id"]
    return items.select("item_id", "text").mapInArrow(run, StructType([kind, StructField("_kind", IntegerType()), StructField("_k", LongType())]))


def bitmap(keys: DataFrame) -> Broadcast:
    """What ``_k`` may be: 16 bits for each key, 8 MB at most whatever their number. A full one lets all through."""
    own = keys.select("_k").distinct()
    log = min(max((16 * own.count()).bit_length(), 12), MOST)
    words = own.select(F.shiftrightunsigned("_k", 64 - log).alias("p")).selectExpr("shiftrightunsigned(p, 6) as at", "shiftleft(1L, cast(p & 63 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (log - 6), "i8")
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view("u8"))


def text_keys(texts: DataFrame, kinds: list[int], bits: Broadcast) -> DataFrame:
    """(doc_id, _k) of texts (doc_id, text), none of them null: the keys of these kinds that the bitmap has, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            at = np.frombuffer(text.buffers()[1], "i8")[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", "u1")
            first = 0
            while first < len(text):  # whole texts, one at least
                last = max(int(np.searchsorted(at, at[first] + STEP, "right")) - 1, first + 1)
                row, key = _places(data[at[first] : at[last]], at[first : last + 1] - at[first], kinds, bits.value)
                yield pa.record_batch([b.column("doc_id").take(pa.array(row + first)), pa.array(key.view("i8"))], ["doc_id", "_k"])
                first = last

    return texts.select("doc_id", "text").mapInArrow(run, StructType([texts.schema["doc_id"], StructField("_k", LongType())]))
