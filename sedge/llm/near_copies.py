"""Near copies: texts whose sets of shingles have a Jaccard similarity of a given size, exactly checked.

Fingerprints (see ``simhash``) find groups of candidates; within a group each pair whose fingerprints are near is held
against the shingles themselves. Texts with one set of shingles are one node; only groups of two nodes and more have
their texts read again, and a group's sets travel once, or once for each block that theirs meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import simhash
from sedge.llm.common import cut, parts, raw, slices, split_join, text_key
from sedge.llm.components import components

#: Bytes of shingle sets, and sets, that are compared as one block.
BLOCK, MEMBERS = 16 << 20, 16_384
#: Bits of one fingerprint within which two texts that meet at an anchor are held against each other.
LOOSE = 16
#: Texts of groups up to which their keys are broadcast (16 bytes each).
FEW = 500_000


def _own(size: int, seed: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, sets, lengths = [], [], []
            for t in raw(b.column(2)):
                h = simhash.shingles(t or b"", size, seed)
                some = np.unique(h)
                fps.append(simhash.summed(h, tables))
                sets.append(xxhash.xxh64_intdigest(some.tobytes()))
                lengths.append(len(some))
            fps = np.array(fps, "u8").reshape(-1, tables).view("i8")
            lists = pa.ListArray.from_arrays(np.arange(0, fps.size + 1, tables, dtype="i4"), pa.array(fps.ravel()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps[:, 0]), lists, pa.array(simhash.nodes_of(fps)), pa.array(np.array(sets, "u8").view("i8")), pa.array(np.array(lengths, "i8"))], ["doc_id", "txt", "fp", "fps", "print", "node", "n"])

    return run


def _deal(size: int, seed: int):
    """The set of each text, once for each pair of blocks that its own is one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for text, top, node, fps, k in zip(raw(b.column(0)), *(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                data = np.unique(simhash.shingles(text, size, seed)).tobytes()
                mine = int(simhash.mixed(np.array([node], "i8").view("u8"), 1)[0] % np.uint64(k))
                out += [(top, min(mine, other), max(mine, other), node, fps, data) for other in range(k)]
                if len(out) > 256:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["root", "lo", "hi", "node", "fps", "shingles"])


def similar(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of ``others`` have a Jaccard similarity of ``least`` or more to ``one``; sets are sorted and not empty."""
    n = np.array([len(x) for x in others])
    both = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, both), len(one) - 1)
    shared = np.add.reduceat(one[at] == both, np.r_[0, np.cumsum(n)[:-1]], dtype="i8")
    return shared >= least * (len(one) + n - shared) - 1e-9


def forest(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], total: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are near by fingerprints and similar by their sets."""
    n = np.array([len(s) for s in sets])
    rest, out = np.arange(len(nodes)), []
    while len(rest):
        root, wave, rest = rest[0], [rest[0]], rest[1:]
        while wave and len(rest):
            i = wave.pop()
            bits = np.bitwise_count(fps[rest] ^ fps[i])
            near = (bits.sum(1, dtype="i8") <= total) & (np.minimum(n[rest], n[i]) >= least * np.maximum(n[rest], n[i]) - 1e-9)
            hit = np.flatnonzero(near)
            for j in range(0, len(hit), 64):
                few = hit[j:j + 64]
                near[few] = similar(sets[i], [sets[x] for x in rest[few]], least)
            wave += rest[near].tolist()
            out += [(int(nodes[root]), int(nodes[x])) for x in rest[near]]
            rest = rest[~near]
    return out


def _compare(total: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for s in slices([b], 64) for row in zip(*(c.to_pylist() for c in s.columns), strict=True))
        for _, group in groupby(rows, key=lambda row: row[:3]):
            nodes, fps, sets = zip(*((row[3], row[4], np.frombuffer(row[5], "u8")) for row in group), strict=True)
            links = forest(np.array(nodes, "i8"), np.array(fps, "i8").view("u8"), list(sets), total, least)
            if links:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, seed: int = 42, distance: int = 8, tables: int = 3, total: int = 40, least: float = 0.8, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(doc_id, txt, fp, root, component_id), a row for each row, as of ``simhash.near_duplicates``.

    Two texts link that have the same set of shingles, or that are candidates and whose sets have a Jaccard similarity of
    ``least`` or more. Candidates differ in at most ``total`` bits over all fingerprints and meet at an anchor of some
    table, as all do that differ in at most ``distance`` bits there, or in at most ``distance`` // 3 bits of one of its
    three parts; chains of candidates are held against each other too. A text of fewer than ``size`` words is one
    shingle. Texts with no words, null ones too, have one set and link to each other alone; repeated rows are copies;
    an empty table gives an empty one; other columns are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("txt"), F.col(text_col).alias("text"))
    own = cut(given.mapInArrow(_own(size, seed, tables), "doc_id bigint, txt bigint, fp bigint, fps array<bigint>, print bigint, node bigint, n bigint"))
    # a set has several fingerprints where shingles repeat, and a fingerprint several sets
    forms = cut(own.where("n > 0").groupBy("print", "node").agg(F.min("fps").alias("fps"), F.min("n").alias("n"), F.min("txt").alias("txt")))
    prints = cut(forms.groupBy("print").agg(F.min("fps").alias("fps")))
    groups = components(simhash.links_of(prints, distance, total, tables, 1 << 62, loose=LOOSE)).select(F.col("node").alias("print"), "root")
    grouped = cut(split_join(forms, groups, ["print"], "left").withColumn("root", F.coalesce("root", "print")))
    sizes = grouped.groupBy("root").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.sum(F.col("n") * 8) / block, F.count("*") / MEMBERS)).cast("long").alias("k")).where("m > 1").drop("m")
    wanted = cut(split_join(grouped, sizes, ["root"]).select("txt", "root", "node", "fps", "k"))
    keys = wanted.select("txt").distinct()
    texts = given.select("txt", "text")
    texts = texts.join(F.broadcast(keys), "txt", "left_semi") if wanted.count() <= few else texts.join(keys, "txt", "left_semi")
    texts = texts.groupBy("txt").agg(F.first("text").alias("text"))  # copies are let go before the shuffle
    dealt = texts.join(wanted, "txt").select("text", "root", "node", "fps", "k").mapInArrow(_deal(size, seed), "root bigint, lo bigint, hi bigint, node bigint, fps array<bigint>, shingles binary")
    at = ["root", "lo", "hi"]
    links = dealt.repartition(parts(docs), *at).sortWithinPartitions(*at).mapInArrow(_compare(total, least), "a bigint, b bigint")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    classed = cut(split_join(nodes, components(links), ["node"], "left").withColumn("root", F.coalesce("root", "node")))
    first = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = split_join(classed, first, ["root"]).select("node", "root", "component_id")
    return split_join(own.select("doc_id", "txt", "fp", "node"), of, ["node"], "left").select("doc_id", "txt", "fp", "root", "component_id")
