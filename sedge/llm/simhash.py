"""SimHash fingerprints and their linking through the anchors of a covering code.

The 64 bits are cut into three parts of 22, 21 and 21 bits, each padded to the 23 bits of the binary Golay code, whose
4,096 words lie within three bits of every vector. A fingerprint's home anchor is the code word nearest to a part. Two
fingerprints that differ in at most d bits differ in at most d // 3 bits within some part, or in at most 2 * d // 3
within some two parts. So a fingerprint is copied to each anchor within the covering radius plus that share of d; every
link then shows at the home anchor of one of its two ends. A text may have several independent fingerprints, each with
anchors of its own. Distinct fingerprints alone are compared, in blocks, and an
anchor passes on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import cut, parts, raw, slices, split_join, text_key
from sedge.llm.components import components

WIDTHS, LENGTH, CHECKS = (22, 21, 21), 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the Golay code.
GENERATOR = 0b110001110101
#: Distinct fingerprints from which on anchors take two parts in place of one: more copies each, far fewer comparisons.
WIDE_FROM = 20_000_000
#: Members of an anchor that are compared as one block, and how many of them are held against all others at once.
BLOCK, STEP = 16_384, 16
#: Nodes of which a task remembers what its links have joined.
JOINED = 1 << 18
#: Fingerprints whose members are packed together.
FULL = 4096
#: Bits below the number of the table in an anchor's first key.
TABLE = LENGTH + 3


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (k = 0: itself), by the finaliser of SplitMix64."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: bytes, size: int, seed: int) -> np.ndarray:
    """The hashes of a text's shingles (ASCII letters lower-cased, ``size`` words a shingle, repeats counted)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(size, len(words))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1:].tolist(), strict=False)], "<u8")


def summed(hashes: np.ndarray, tables: int = 1) -> list[int]:
    """The ``tables`` fingerprints of the hashes of one text's shingles; of none they are zero."""
    if not len(hashes):
        return [0] * tables
    count = np.zeros((tables, 64), "i8")
    for i in range(0, len(hashes), 4096):
        for t in range(tables):
            some = mixed(hashes[i:i + 4096], t)
            count[t] += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return np.packbits(2 * count > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: bytes, size: int, seed: int, tables: int = 1) -> list[int]:
    """The ``tables`` fingerprints of one text (ASCII letters lower-cased, ``size`` words a shingle, repeats counted)."""
    return summed(shingles(text, size, seed), tables)


def nodes_of(fps: np.ndarray) -> np.ndarray:
    """One number for each row of fingerprints: the fingerprint itself where there is but one, else a hash of all."""
    node = fps[:, 0].view("u8").copy() if fps.shape[1] == 1 else np.zeros(len(fps), "u8")
    if fps.shape[1] > 1:
        for t in range(fps.shape[1]):
            node = mixed(node ^ fps[:, t].view("u8"), t + 1)
    return node.view("i8")


def _fingerprints(size: int, seed: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t or b"", size, seed, tables) for t in raw(b.column(2))], "u8").reshape(-1, tables)
            lists = pa.ListArray.from_arrays(np.arange(0, fps.size + 1, tables, dtype="i4"), pa.array(fps.view("i8").ravel()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view("i8")[:, 0]), lists, pa.array(nodes_of(fps.view("i8")))], ["doc_id", "txt", "fp", "fps", "node"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, seed: int = 42, tables: int = 1) -> DataFrame:
    """(doc_id, txt, fp bigint, fps array<bigint>, node bigint), a row for each row; txt is xxhash64 of the text, fps are
    its ``tables`` fingerprints, fp the first of them, node a number for them all. Null, empty and blank texts have
    fingerprints of zero; a text of fewer than ``size`` words is one shingle; a null id stays null."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("txt"), F.col(text_col).alias("text"))
    return own.mapInArrow(_fingerprints(size, seed, tables), "doc_id bigint, txt bigint, fp bigint, fps array<bigint>, node bigint")


@lru_cache(4)
def _patterns(slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to 3 + slack bits by their syndrome: patterns, bits over the radius, first index of each."""
    one = []
    for i in range(LENGTH):
        x = 1 << i
        for j in range(LENGTH - 1, CHECKS - 1, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - CHECKS)
        one.append(x)
    found = sorted((int(np.bitwise_xor.reduce([0, *(one[i] for i in c)])), sum(1 << i for i in c), max(0, w - 3)) for w in range(4 + slack) for c in combinations(range(LENGTH), w))
    syndromes = np.array([f[0] for f in found])
    return np.array([f[1] for f in found], "i8"), np.array([f[2] for f in found], "i8"), np.searchsorted(syndromes, np.arange((1 << CHECKS) + 1))


@lru_cache(1)
def _syndromes() -> np.ndarray:
    """The syndrome of each vector of 23 bits."""
    x = np.arange(1 << LENGTH, dtype="i4")
    for j in range(LENGTH - 1, CHECKS - 1, -1):
        x ^= (x >> j & 1) * np.int32(GENERATOR << (j - CHECKS))
    return x.astype("i2")


def _words_near(part: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector: the code words within radius + slack as (index of the vector, word, bits over the radius)."""
    pattern, over, first = _patterns(slack)
    s = _syndromes()[part]
    n = first[s + 1] - first[s]
    who = np.repeat(np.arange(len(part)), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
    return who, part[who] ^ pattern[at], over[at]


def anchors_of(prints: np.ndarray, distance: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, first key, second key, home): the anchors to which each fingerprint goes."""
    cuts = np.cumsum([0, *WIDTHS])
    part = [(prints >> np.uint64(cuts[i]) & np.uint64((1 << WIDTHS[i]) - 1)).astype("i8") for i in range(3)]
    out = []
    if wide:
        slack = 2 * distance // 3
        near = [_words_near(p, slack) for p in part]
        for t, (i, j) in enumerate(combinations(range(3), 2)):
            (wi, ci, oi), (wj, cj, oj) = near[i], near[j]
            n = np.bincount(wj, minlength=len(prints))
            first = np.cumsum(n) - n
            m = n[wi]
            left = np.repeat(np.arange(len(wi)), m)
            right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[wi], m)
            ok = oi[left] + oj[right] <= slack
            left, right = left[ok], right[ok]
            out.append((wi[left], (t << LENGTH) + ci[left], cj[right], oi[left] + oj[right] == 0))
    else:
        for t in range(3):
            who, word, over = _words_near(part[t], distance // 3)
            out.append((who, (t << LENGTH) + word, np.zeros(len(who), "i8"), over == 0))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _member(tables: int) -> np.dtype:
    """A member of an anchor as it travels: its fingerprints and whether the anchor is its home."""
    return np.dtype([("fps", "<i8", (tables,)), ("home", "?")])


def _pack(members: np.ndarray, keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each distinct key: the key, the number of its members, and these as bytes."""
    order = np.lexsort(keys[::-1])
    keys, members = [k[order] for k in keys], members[order]
    starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(members) else np.zeros(0, "i8")
    ends = np.r_[starts[1:], len(members)] if len(starts) else starts
    offsets = (np.r_[starts, len(members)] * members.itemsize).astype("i4")
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(members.tobytes())])
    return pa.record_batch([*(pa.array(k[starts]) for k in keys), pa.array(ends - starts), packed], [*names, "n", "members"])


def _spread(distance: int, wide: bool, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024 if wide else FULL):
            fps = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(-1, tables)
            for t in range(tables):  # one at a time: what a worker holds does not grow with the tables
                who, x, y, home = anchors_of(fps[:, t].copy().view("u8"), distance, wide)
                members = np.empty(len(who), _member(tables))
                members["fps"], members["home"] = fps[who], home
                yield _pack(members, [x + (t << TABLE), y], ["x", "y"])

    return run


def _dealt(b: pa.RecordBatch, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, members, k): members of an anchor of k > 1 blocks go to each pair of blocks that theirs is one of."""
    x, y, members, k = (b.column(i) for i in range(4))
    one = pa.compute.equal(k, 1)
    zero = pa.array(np.zeros(b.num_rows, "i8"))
    yield pa.record_batch([x, y, zero, zero, members], ["x", "y", "lo", "hi", "members"]).filter(one)
    many = b.filter(pa.compute.invert(one))
    for ax, ay, data, blocks in zip(*(c.to_pylist() for c in many.columns), strict=True):
        m = np.frombuffer(data, _member(tables))
        own = (mixed(nodes_of(m["fps"]).view("u8"), 1) % np.uint64(blocks)).astype("i8")
        mine, other = np.repeat(own, blocks), np.tile(np.arange(blocks), len(m))
        got = _pack(np.repeat(m, blocks), [np.minimum(mine, other), np.maximum(mine, other)], ["lo", "hi"])
        at = [pa.array(np.full(got.num_rows, v, "i8")) for v in (ax, ay)]
        yield pa.record_batch([*at, got.column(0), got.column(1), got.column(3)], ["x", "y", "lo", "hi", "members"])


def _deal(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _dealt(b, tables)

    return run


def _spread_and_deal(distance: int, tables: int, sent: Broadcast):
    """Both steps in one, the blocks of each large anchor being known: {x: k}."""
    spread = _spread(distance, False, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spread(batches):
            k = pa.array([sent.value.get(x, 1) for x in b.column(0).to_pylist()], pa.int64())
            yield from _dealt(pa.record_batch([b.column(0), b.column(1), b.column(3), k], ["x", "y", "members", "k"]), tables)

    return run


def _near(a: np.ndarray, b: np.ndarray, table: int, distance: int, total: int | None) -> np.ndarray:
    """Which of ``a`` and ``b`` link: within ``distance`` in one table and, where asked for, within ``total`` over all."""
    near = np.bitwise_count(a[:, None, table] ^ b[None, :, table]) <= distance
    if total is not None:
        i, j = np.nonzero(near)
        near[i, j] = np.bitwise_count(a[i] ^ b[j]).sum(1) <= total
    return near


def forest(fps: np.ndarray, home: np.ndarray, table: int, distance: int, total: int | None = None) -> np.ndarray:
    """Links (two columns of nodes) that join what linked pairs, one end at home, join: a star for each component."""
    order = np.argsort(nodes := nodes_of(fps), kind="stable")
    fps, home, nodes = fps[order].view("u8"), home[order], nodes[order]
    touched = np.zeros(len(fps), bool)
    own = np.flatnonzero(home)
    for i in range(0, len(own), STEP):
        rows = own[i:i + STEP]
        near = _near(fps[rows], fps, table, distance, total)
        many = near.sum(1) > 1
        touched[rows[many]] = True
        touched |= near[many].any(0)
    rest = np.flatnonzero(touched)
    out = []
    while len(rest):
        root, wave, rest = rest[0], rest[:1], rest[1:]
        while len(wave) and len(rest):
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(wave), STEP):
                hit |= _near(fps[wave[i:i + STEP]], fps[rest], table, distance, total).any(0)
            wave, rest = rest[hit], rest[~hit]
            out.append(np.stack([np.full(len(wave), nodes[root]), nodes[wave]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), "i8")


def joins(root: dict[int, int], a: int, b: int) -> bool:
    """Whether a link joins what earlier ones have not joined yet; ``root`` is where each node leads."""
    ends = []
    for x in (a, b):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        ends.append(x)
    root[max(ends)] = min(ends)
    return ends[0] != ends[1]


def _compare(distance: int, total: int | None, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in slices(batches, 64) for row in zip(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True), b.column(4).to_pylist(), strict=True))
        out, held = [], 0
        root: dict[int, int] = {}  # near texts meet at many anchors of a task: what one has joined the others need not
        for key, group in groupby(rows, key=lambda row: row[0]):
            m = np.frombuffer(b"".join(data for _, data in group), _member(tables))
            if len(m) > 1:
                found = forest(m["fps"], m["home"], key[0] >> TABLE, distance, total)
                new = found[[joins(root, a, b) for a, b in found.tolist()]] if len(found) else found
                if len(new):
                    out.append(new)
                    held += len(new)
            if len(root) > JOINED:
                root = {}  # some links come again, none is lost
            if held > 50_000:
                yield _links(out)
                out, held = [], 0
        if held:
            yield _links(out)

    return run


def _links(found: list[np.ndarray]) -> pa.RecordBatch:
    links = np.concatenate(found)
    return pa.record_batch([pa.array(np.ascontiguousarray(links[:, i])) for i in (0, 1)], ["a", "b"])


def links_of(prints: DataFrame, distance: int = 4, total: int | None = None, tables: int = 1, wide_from: int = WIDE_FROM, block: int = BLOCK, loose: int | None = None) -> DataFrame:
    """(a, b) bigint: links between distinct nodes (``fps``) that join all pairs within ``distance`` bits in some table
    and, where ``total`` is given, within so many bits over all tables. With ``loose``, pairs that happen to meet at an
    anchor link within so many bits of its table; pairs within ``distance`` are still the only ones sure to meet.

    Members travel packed, a row for each anchor and batch. An anchor of more than ``block`` members is cut into blocks
    and each two blocks meet in one task, so a task holds two blocks at most and misses nothing.
    """
    n = prints.count()
    wide = n >= wide_from
    full = prints.select("fps").coalesce(max(1, -(-n // FULL)))  # full batches pack the same, however the rows lie
    spread = full.mapInArrow(_spread(distance, wide, tables), "x bigint, y bigint, n bigint, members binary")
    out = "x bigint, y bigint, lo bigint, hi bigint, members binary"
    if wide:
        spread = cut(spread)
        sizes = spread.groupBy("x", "y").agg(F.sum("n").alias("total")).where("total > 1")
        sized = split_join(spread, sizes, ["x", "y"])
        dealt = sized.select("x", "y", "members", F.ceil(F.col("total") / block).cast("long").alias("k")).mapInArrow(_deal(tables), out)
    else:  # there are 3 x 4,096 anchors a table, whatever the number of rows
        large = spread.groupBy("x").agg(F.sum("n").alias("total")).where(F.col("total") > block).collect()
        sent = prints.sparkSession.sparkContext.broadcast({r.x: -(-r.total // block) for r in large})
        dealt = full.mapInArrow(_spread_and_deal(distance, tables, sent), out)
    keys = ["x", "y", "lo", "hi"]
    return dealt.repartition(parts(prints), *keys).sortWithinPartitions(*keys).mapInArrow(_compare(distance if loose is None else loose, total, tables), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, seed: int = 42, distance: int = 4, tables: int = 1, total: int | None = None, wide_from: int = WIDE_FROM, block: int = BLOCK) -> DataFrame:
    """(doc_id, txt, fp, root, component_id), a row for each row: component_id is the smallest doc_id reachable over
    links, root the component's own node, txt xxhash64 of the text, fp the first fingerprint.

    With more ``tables`` a text has as many independent fingerprints, and two link that lie within ``distance`` bits in
    any of them and within ``total`` bits over all: more tables find more of the similar, the total tells them apart.

    Documents with no words share fingerprints of zero and link as any other. A null id comes back, linked by its
    fingerprints, and is never a component's id unless all its ids are null. An empty table gives an empty one.
    """
    own = cut(fingerprints(docs, id_col, text_col, size, seed, tables))
    prints = cut(own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fps").alias("fps")))
    roots = components(links_of(prints, distance, total, tables, wide_from, block))
    classed = cut(prints.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = split_join(classed, least, ["root"]).select("node", "root", "component_id")
    return split_join(own.drop("fps"), of, ["node"], "left").select("doc_id", "txt", "fp", "root", "component_id")
