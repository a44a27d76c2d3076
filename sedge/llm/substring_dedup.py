"""Removal of long word sequences that an earlier document holds, by super-k-mer partitioning.

A window is ``size`` consecutive words. Its minimiser is the run of eight words in it with the least hash; consecutive
windows with the minimiser at one place form a super-k-mer. Equal windows have equal minimisers, so

1. minimisers that one document alone holds are done with (numbers travel, no text);
2. of the rest, super-k-mers with equal words are one row with their smallest document, which settles every minimiser
   that has but one such row, as copies of a text do;
3. the others travel once each as one packed string to their minimiser's bucket, where sorting finds the smallest
   document of each window exactly. A bucket of very many strings is dealt out again by window.

Documents are compressed before they are shuffled to meet what was found about them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import cut, fresh, parts, raw, slices, split_join, text_key, without

SIZE = 50
#: Words of a minimiser; eight, as its hash is built by doubling.
MINIMISER = 8
#: Strings in a bucket from which on it is dealt out by window.
LARGE = 2000


def _mixed(words: list[bytes]) -> np.ndarray:
    """A hash for each run of eight words."""
    h = xxhash.xxh3_64_intdigest
    g = np.fromiter(map(h, words), "u8", len(words))
    base = 0x9E3779B97F4A7C15
    for step in (1, 2, 4):
        g = g[:-step] * np.uint64(pow(base, step, 1 << 64)) + g[step:]
    g = (g ^ g >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ g >> np.uint64(32)


def super_kmers(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser's hash, first window, number of windows) of each super-k-mer; none if there are fewer than ``size`` words."""
    if len(words) < size:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    g = _mixed(words)
    width, have, at = size - MINIMISER + 1, 1, np.arange(len(g))
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        have += step
    first = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
    return g[at[first]].view("i8"), first, np.diff(np.r_[first, len(at)])


def _edges(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by blanks, and where each begins; word i ends a byte before word i + 1 begins."""
    return b" ".join(words), np.r_[0, np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)]


def _numbers(size: int, keyed: bool):
    """(m, doc_id) or (m, s1, s2, doc_id, txt, start, n): a row for each super-k-mer; s1 and s2 hash its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            digests = []
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
                words = (text or b"").split()
                m, first, n = super_kmers(words, size)
                if not len(m):
                    continue
                if not keyed:
                    m = np.unique(m)
                    out.append(np.stack([m, np.full(len(m), i)]))
                    continue
                joined, at = _edges(words)
                digest = xxhash.xxh3_128_digest
                digests += [digest(joined[a:z]) for a, z in zip(at[first].tolist(), (at[first + n + size - 1] - 1).tolist(), strict=True)]
                out.append(np.stack([m, np.full(len(m), i), np.full(len(m), t), first, n]))
            if not out:
                continue
            rows = [pa.array(x) for x in np.concatenate(out, axis=1)]
            if keyed:
                s = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype("i8")
                yield pa.record_batch([rows[0], pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), *rows[1:3], rows[3].cast(pa.int32()), rows[4].cast(pa.int32())], ["m", "s1", "s2", "doc_id", "txt", "start", "n"])
            else:
                yield pa.record_batch(rows, ["m", "doc_id"])

    return run


def _squeezed(at: int):
    """Texts compressed, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            cols = list(b.columns)
            cols[at] = pa.array([c.compress(t or b"") for t in raw(b.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return run


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in slices(batches, 256):
            rows = []
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                joined, at = _edges(d.decompress(text).split())
                for w in wanted:
                    rows.append((w["m"], w["s1"], w["s2"], w["lo"], w["strings"], joined[at[w["start"]]:at[w["start"] + w["n"] + size - 1] - 1]))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["m", "s1", "s2", "lo", "strings", "words"])

    return run


def _windows(words: bytes, size: int) -> list[bytes]:
    own = words.split(b" ")
    _, at = _edges(own)
    return [words[at[i]:at[i + size] - 1] for i in range(len(own) - size + 1)]


def _bucket(size: int):
    """Rows sorted by minimiser: each string's list of the smallest document of each of its windows."""

    def done(held: list[tuple]) -> list[tuple]:
        runs = sorted((w, lo, k, i) for k, (_, _, lo, words) in enumerate(held) for i, w in enumerate(_windows(words, size)))
        out: list[dict[int, int]] = [{} for _ in held]
        last, low = None, 0
        for w, lo, k, i in runs:
            if w != last:
                last, low = w, lo
            out[k][i] = low
        return [(h[0], h[1], [o[i] for i in range(len(o))]) for h, o in zip(held, out, strict=True)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["s1", "s2", "mins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []
        for b in slices(batches):
            for m, s1, s2, lo, words in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if m != last and held:
                    out += done(held)
                    held = []
                    if len(out) > 2000:
                        yield batch(out)
                        out = []
                last = m
                held.append((s1, s2, lo, words))
        out += done(held)
        if out:
            yield batch(out)

    return run


def _exploded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            rows, d = [], []
            for s1, s2, lo, words in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                own = _windows(words, size)
                d += map(digest, own)
                rows += [(s1, s2, lo, i) for i in range(len(own))]
            if rows:
                w = np.frombuffer(b"".join(d), ">i8").reshape(-1, 2).astype("i8")
                yield pa.record_batch([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["w1", "w2", "s1", "s2", "lo", "i"])

    return run


def repeated(docs: DataFrame, size: int = SIZE, large: int = LARGE) -> DataFrame:
    """(doc_id, txt, found): per document with windows of an earlier one, structs (start, n, mins).

    ``docs`` has doc_id, txt and text. A struct covers the windows from ``start`` on, ``n`` of them; ``mins`` lists the
    smallest document of each, or is null where every one has the same smaller one.
    """
    src = docs.where("doc_id is not null")
    n = parts(docs)
    shared = src.mapInArrow(_numbers(size, False), "m bigint, doc_id bigint").groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m")
    numbers = src.mapInArrow(_numbers(size, True), "m bigint, s1 bigint, s2 bigint, doc_id bigint, txt bigint, start int, n int")
    places = cut(split_join(numbers, shared, ["m"]))
    first = places.groupBy("m", "s1", "s2").agg(F.min(F.struct("doc_id", "txt", "start", "n")).alias("at"))
    strings = cut(first.select("m", "s1", "s2", F.col("at.doc_id").alias("lo"), F.col("at.txt").alias("txt"), F.col("at.start").alias("start"), F.col("at.n").alias("n")))
    several = strings.groupBy("m").agg(F.count("*").alias("strings")).where("strings > 1")
    wanted = split_join(strings, several, ["m"]).withColumn("doc_id", F.col("lo")).groupBy("doc_id", "txt").agg(F.collect_list(F.struct("m", "s1", "s2", "lo", "strings", "start", "n")).alias("wanted"))
    squeezed = src.select("doc_id", "txt", "text").mapInArrow(_squeezed(2), "doc_id bigint, txt bigint, text binary")
    packed = cut(squeezed.join(wanted, ["doc_id", "txt"]).select("text", "wanted").mapInArrow(_packed(size), "m bigint, s1 bigint, s2 bigint, lo bigint, strings bigint, words binary").dropDuplicates(["m", "s1", "s2"]))
    columns = ["m", "s1", "s2", "lo", "words"]
    small = packed.where(F.col("strings") <= large).select(*columns).repartition(n, "m").sortWithinPartitions("m").mapInArrow(_bucket(size), "s1 bigint, s2 bigint, mins array<bigint>")
    spread = packed.where(F.col("strings") > large).select(*columns).mapInArrow(_exploded(size), "w1 bigint, w2 bigint, s1 bigint, s2 bigint, lo bigint, i bigint")
    least = spread.groupBy("w1", "w2").agg(F.min("lo").alias("least"))
    hot = split_join(spread, least, ["w1", "w2"]).groupBy("s1", "s2").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("own")).select("s1", "s2", F.col("own.least").alias("mins"))
    solved = small.unionByName(hot)
    known = strings.select("s1", "s2", "lo").join(solved, ["s1", "s2"], "left")
    found = split_join(places, known, ["s1", "s2"]).where("mins is null and lo < doc_id or mins is not null and exists(mins, x -> x < doc_id)")
    return found.groupBy("doc_id", "txt").agg(F.collect_list(F.struct("start", "n", "mins")).alias("found"))


def _removed(size: int, id_at: int, text_at: int, found_at: int, null_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in slices(batches, 256):
            out, total, gone = [], [], []
            for i, text, found in zip(b.column(id_at).to_pylist(), b.column(text_at).to_pylist(), b.column(found_at).to_pylist(), strict=True):
                words = d.decompress(text).split()
                steps = np.zeros(len(words) + 1, "i8")
                for f in found or ():
                    if f["mins"] is None:
                        steps[f["start"]] += 1
                        steps[f["start"] + f["n"] - 1 + size] -= 1
                    else:
                        at = f["start"] + np.flatnonzero(np.array(f["mins"]) < i)
                        np.add.at(steps, at, 1)
                        np.add.at(steps, at + size, -1)
                keep = np.cumsum(steps)[:-1] == 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if found else words
                out.append(b" ".join(kept))
                total.append(len(words))
                gone.append(len(words) - len(kept))
            cols = list(b.columns)
            cols[text_at] = pa.array(out, pa.binary()).cast(pa.string())
            names = b.schema.names
            keep_at = [k for k in range(len(cols)) if k not in (found_at, null_at)]
            sha = pa.array([hashlib.sha256(o).hexdigest() for o in out])
            yield pa.RecordBatch.from_arrays([*(cols[k] for k in keep_at), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), sha], [*(names[k] for k in keep_at), "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, large: int = LARGE) -> DataFrame:
    """``docs`` with repeated passages taken out of the text (kept words joined by one blank), and ``n_words``,
    ``n_removed`` and ``kept_sha256`` added.

    A word goes if a window over it also starts in a document with a smaller id; all windows are judged on the input.
    Every row comes back. Null or empty text has no words and comes back empty; a null id keeps its words and takes
    none from others; rows repeating an id are one document to the rule. All input columns come back, but for those
    named like an added one; an empty table gives an empty one; texts of any length are taken whole. ``size`` must be at
    least 8.
    """
    own = without(docs, "n_words", "n_removed", "kept_sha256")
    mine, theirs, key, places = (fresh(x, docs) for x in ("_txt", "_t", "_id", "_found"))
    named = own.withColumn(mine, F.xxhash64(F.col(f"`{text_col}`")))
    found = repeated(own.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("txt"), F.col(text_col).alias("text")), size, large)
    found = found.select(F.col("doc_id").alias(key), F.col("txt").alias(theirs), F.col("found").alias(places))
    at = {c.lower(): i for i, c in enumerate(own.columns)}
    kinds = [f"`{f.name}` " + ("binary" if i == at[text_col.lower()] else f.dataType.simpleString()) for i, f in enumerate(own.schema)]
    squeezed = named.mapInArrow(_squeezed(at[text_col.lower()]), ", ".join([*kinds, f"{mine} bigint"]))
    both = squeezed.join(found, (F.col(f"`{id_col}`").cast("long") == F.col(key)) & (F.col(mine) == F.col(theirs)), "left").drop(key, theirs)
    last = ", ".join(f"`{f.name}` {'string' if i == at[text_col.lower()] else f.dataType.simpleString()}" for i, f in enumerate(own.schema))
    k = len(own.columns)
    return both.mapInArrow(_removed(size, at[id_col.lower()], at[text_col.lower()], k + 1, k), f"{last}, n_words bigint, n_removed bigint, kept_sha256 string")
