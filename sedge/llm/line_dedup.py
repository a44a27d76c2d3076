"""Exact line deduplication over a corpus.

Every line's key (white space stripped at both ends, ASCII letters lower-cased) is hashed to 128 bits. The rows
(hash, document, positions) are range-partitioned by hash *and* document, so a line that a third of the corpus
shares is spread over many partitions, and sorted by hash, document and position. One streaming pass over each
partition then knows the first document of every run. Runs that cross a partition's edge are joined up through one
(first key, last key) row per partition. What leaves the pass is no text: each document gets a compressed bitmap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import cut, fresh, parts, raw, slices, text_key, without

LINES = "h1 bigint, h2 bigint, doc_id bigint, txt bigint, pos int, more binary"


def _lines_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            keys, ids, txt, pos, more = [], [], [], [], []
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
                at: dict[bytes, list[int]] = {}
                for n, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip().lower()  # on bytes: exactly ASCII white space and A-Z
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                        at.setdefault(digest(key), []).append(n)
                for key, where in at.items():
                    keys.append(key)
                    ids.append(i)
                    txt.append(t)
                    pos.append(where[0])
                    more.append(np.array(where[1:], "<i4").tobytes() if len(where) > 1 else None)
            h = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype("i8")
            yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(txt, pa.int64()), pa.array(pos, pa.int32()), pa.array(more, pa.binary())], ["h1", "h2", "doc_id", "txt", "pos", "more"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first key, its last key, and the first document of the last key's run."""
    first = last = None
    for b in batches:
        if b.num_rows:
            h1, h2, d = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if first is None:
                first = (int(h1[0]), int(h2[0]), int(d[0]))
            start = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
            k = int(start[-1]) + 1 if len(start) else 0
            if k or last is None or last[:2] != (int(h1[-1]), int(h2[-1])):
                last = (int(h1[k]), int(h2[k]), int(d[k]))
    if first is not None:
        yield pa.record_batch([pa.array([x]) for x in (TaskContext.get().partitionId(), *first, *last)], ["p", "a1", "a2", "a", "z1", "z2", "z"])


def _later(carry: dict[int, tuple[int, int, int]]):
    """Rows whose key a smaller document holds. ``carry``: per partition, the key that runs in and its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1, k2, k = carry.get(TaskContext.get().partitionId(), (None, None, None))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h1, h2, d = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            begin = np.flatnonzero(new)
            first = d[begin]
            if k1 is not None and (h1[0], h2[0]) == (k1, k2):
                first = first.copy()
                first[0] = k
            run_of = np.cumsum(new) - 1
            late = d > first[run_of]
            k1, k2, k = int(h1[-1]), int(h2[-1]), int(first[-1])
            if late.any():
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(late)) for i in (2, 3, 4, 5)], ["doc_id", "txt", "pos", "more"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for pos, more in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            gone = np.concatenate([np.array(pos, "i4"), *(np.frombuffer(m, "<i4") for m in more)])
            keep = np.ones(int(gone.max()) // 8 * 8 + 8, bool)  # whole bytes, so that no padding bit reads as a drop
            keep[gone] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([int(x) for x in map(len, out)], pa.int32()), pa.array(out, pa.binary())], ["doc_id", "txt", "bytes", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, txt, bytes, keep): for each document that loses lines, its zlib-packed bitmap, 1 for a line that stays.

    Lines past a bitmap's end stay. ``txt`` is xxhash64
    of the text, so that rows repeating an id with other text keep bitmaps of their own. A line with a key of at least
    ``min_chars`` code points stays only in the smallest id holding it (there, every repeat stays). Rows with a null id
    take no part. Null or empty text is one empty line.
    """
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("txt"), F.col(text_col).alias("text"))
    rows = src.mapInArrow(_lines_of(min_chars), LINES)
    order = ["h1", "h2", "doc_id", "txt", "pos"]
    dealt = cut(rows.repartitionByRange(parts(docs), *order[:4]).sortWithinPartitions(*order))
    ends = sorted(dealt.mapInArrow(_ends, "p bigint, a1 bigint, a2 bigint, a bigint, z1 bigint, z2 bigint, z bigint").collect())  # a row a partition
    carry: dict[int, tuple[int, int, int]] = {}
    for before, now in zip(ends, ends[1:], strict=False):
        if (before.z1, before.z2) == (now.a1, now.a2):
            whole = (before.a1, before.a2) == (before.z1, before.z2)  # that key fills the partition before
            carry[now.p] = carry[before.p] if whole and before.p in carry else (before.z1, before.z2, before.z)
    late = dealt.mapInArrow(_later(carry), "doc_id bigint, txt bigint, pos int, more binary")
    gone = late.groupBy("doc_id", "txt").agg(F.collect_list("pos").alias("pos"), F.collect_list("more").alias("more"))
    return gone.mapInArrow(_bitmaps, "doc_id bigint, txt bigint, bytes int, keep binary")


def _applied(text_at: int, keep_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, lines, dropped = [], [], []
            for text, keep in zip(raw(b.column(text_at)), b.column(keep_at).to_pylist(), strict=True):
                text = text or b""
                n = gone = text.count(b"\n") + 1
                if keep is None:
                    gone = 0
                else:
                    own = text.split(b"\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), "u1"))[:n].tolist()
                    kept = [x for x, y in zip(own, bits, strict=False) if y] + own[len(bits):]
                    gone = n - len(kept)
                    text = b"\n".join(kept)
                out.append(text)
                lines.append(n)
                dropped.append(gone)
            cols = [c for i, c in enumerate(b.columns) if i != keep_at]
            names = [c for i, c in enumerate(b.schema.names) if i != keep_at]
            cols[text_at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines`` (before) and ``n_dropped`` added.

    Every row comes back, in any order; a null text comes back empty; a document may end up empty. Input columns named
    like an added column give way to it. An empty table gives an empty table. See :func:`keep_bitmaps` for the rule.
    """
    own = without(docs, "n_lines", "n_dropped")
    i, t, k = (fresh(x, docs) for x in ("_k_id", "_k_txt", "_keep"))
    maps = keep_bitmaps(docs, id_col, text_col, min_chars).select(F.col("doc_id").alias(i), F.col("txt").alias(t), F.col("keep").alias(k))
    left = own.alias("d").join(maps, (F.col(f"d.`{id_col}`").cast("long") == F.col(i)) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col(t)), "left").select("d.*", k)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    at = [c.lower() for c in own.columns].index(text_col.lower())
    return left.mapInArrow(_applied(at, len(own.columns)), f"{kinds}, n_lines bigint, n_dropped bigint")
