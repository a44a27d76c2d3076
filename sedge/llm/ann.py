"""Maximum inner product search over four-bit codes trained by a score-aware loss.

Vectors are cut into subspaces of two dimensions with 16 centroids each. Training and coding weigh the part of a
vector's error that lies along the vector itself more than the rest, as that part moves large inner products most. A
query's 16 products per subspace, added up for pairs of subspaces, are the tables that a scan of the codes reads; the best
of each block of codes are scored again on the original vectors, in double precision.

Codes and queries are packed into block rows on the executors. Blocks of codes are dealt out to groups, each block of
queries goes to every group, and the two meet by an equi join on the group, so no vector passes through the driver but the
sample that the codebooks are fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import cut, parts

#: Vectors that the codebooks are fitted on at most, chosen by hash; every vector is coded.
SAMPLE = 20_000
#: Inner products under this share of the largest possible matter little to the loss.
THRESHOLD = 0.2
#: Queries of a block, of which a chunk at a time has its tables made.
QUERIES, CHUNK = 1024, 64
#: Bytes of vectors in a block, and how many of its vectors each query scores again.
BLOCK_BYTES, AGAIN = 2 << 20, 96
#: Vectors of a group at most, where there are more groups than tasks.
GROUP = 1 << 16
#: Vectors of one length in the sample below which that length has no codebooks: its blocks are scored exactly.
LEAST = 256


@dataclass
class Codebooks:
    dim: int
    weight: float  # of the parallel error, over that of the rest
    centres: np.ndarray  # subspace x 16 x 2


def _pad(x: np.ndarray) -> np.ndarray:
    """To a multiple of four dimensions: two subspaces of two make one byte of code."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).astype("f4")


def code(x: np.ndarray, books: Codebooks, sweeps: int = 2) -> np.ndarray:
    """Centroid numbers (n x subspaces), by coordinate descent on the score-aware loss from the plain nearest ones."""
    x = _pad(x)
    n, subs = len(x), books.centres.shape[0]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    xs, us = x.reshape(n, subs, 2), unit.reshape(n, subs, 2)
    gone = np.empty((n, subs, 16), "f4")  # squared error
    along = np.empty((n, subs, 16), "f4")  # error along the vector
    for m in range(subs):
        d = xs[:, m, None, :] - books.centres[m][None]
        gone[:, m] = (d * d).sum(2)
        along[:, m] = np.einsum("nkd,nd->nk", d, us[:, m])
    codes = gone.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(subs):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (gone[:, m] + (books.weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes.astype("u1")


def train(x: np.ndarray, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Codebooks of a sample, alternating coding and weighted least squares for the centroids."""
    dim = x.shape[1]
    weight = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    p = _pad(x)
    n, subs = len(p), p.shape[1] // 2
    rng = np.random.default_rng(seed)
    centres = np.stack([p[rng.choice(n, 16, replace=n < 16)].reshape(16, subs, 2)[:, m] for m in range(subs)])
    books = Codebooks(dim, weight, centres.astype("f4"))
    unit = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-30)
    xs, us = p.reshape(n, subs, 2), unit.reshape(n, subs, 2)
    for step in range(rounds):
        books.weight = 1.0 if step < rounds // 2 else weight
        codes = code(x, books, 1 if step >= rounds // 2 else 0)
        err = xs - books.centres[np.arange(subs)[None], codes]
        along = np.einsum("nsd,nsd->ns", err, us)
        total = along.sum(1)
        for m in range(subs):
            own = us[:, m]
            target = xs[:, m] + (books.weight - 1) * ((total - along[:, m]) + np.einsum("nd,nd->n", xs[:, m], own))[:, None] * own
            outer = np.eye(2)[None] + (books.weight - 1) * own[:, :, None] * own[:, None, :]
            a, b = np.zeros((16, 2, 2)), np.zeros((16, 2))
            np.add.at(a, codes[:, m], outer)
            np.add.at(b, codes[:, m], target)
            used = np.bincount(codes[:, m], minlength=16) > 0
            books.centres[m][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
    books.weight = weight
    return books


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec, dim): the distinct rows with an id and a vector that is not null, empty or zero and holds finite
    numbers only."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    good = own.where("vec_id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    return good.distinct().withColumn("dim", F.size("vec"))


def codebooks(rows: DataFrame, n: int, sample: int = SAMPLE) -> dict[int, Codebooks]:
    """Codebooks by length, fitted on about ``sample`` of the ``n`` rows, chosen by hash."""
    whole = 1 << 53
    share = F.pmod(F.xxhash64("vec_id"), F.lit(whole)) < int(whole * min(1.0, sample / max(n, 1)))
    some = rows.where(share).orderBy("vec_id", "vec").select("dim", "vec").limit(2 * sample).toArrow()  # bounded by the sample
    dims = some.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        own = some.filter(pa.array(dims == dim)).column("vec").combine_chunks()
        if len(own) >= LEAST:
            out[dim] = train(np.asarray(own.flatten()).reshape(-1, dim))
    return out


def block_rows(dim: int) -> int:
    return max(64, BLOCK_BYTES // (8 * dim))


def _schema(names: list[str]) -> pa.Schema:
    return pa.schema([(n, pa.int32() if n in ("dim", "g") else pa.binary()) for n in names])


def _packed(finish, names: list[str], limit):
    """Rows (vec_id, vec, dim) packed by length, ``limit(dim)`` a block at most; ``finish`` makes a block's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}
        nth = 0

        def done(dim: int) -> pa.RecordBatch:
            nonlocal nth
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            size.pop(dim)
            nth += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, finish(dim, ids, x, nth), strict=True))], _schema(names))

        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                ids, x = own.column(0).to_numpy(), np.asarray(own.column(1).flatten()).reshape(-1, dim)
                most = limit(dim)
                for i in range(0, len(ids), most):
                    if size.get(dim, 0) + len(ids[i:i + most]) > most:
                        yield done(dim)
                    held.setdefault(dim, []).append((ids[i:i + most], x[i:i + most]))
                    size[dim] = size.get(dim, 0) + len(ids[i:i + most])
                while sum(8 * d * m for d, m in size.items()) > 8 * BLOCK_BYTES:  # many lengths: the fullest goes
                    yield done(max(size, key=size.get))
        for dim in list(held):
            yield done(dim)

    return run


def _codes(sent: Broadcast, groups: int):
    def finish(dim: int, ids: np.ndarray, x: np.ndarray, nth: int) -> tuple:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        codes = None
        if books := sent.value.get(dim):
            c = code(x, books)
            codes = (c[:, 0::2] << 4 | c[:, 1::2]).tobytes()
        return dim, (TaskContext.get().partitionId() + nth * 7919) % groups, ids.tobytes(), x.tobytes(), codes

    return _packed(finish, ["dim", "g", "ids", "vecs", "codes"], block_rows)


def _questions(dim: int, ids: np.ndarray, x: np.ndarray, nth: int) -> tuple:
    return dim, ids.tobytes(), x.tobytes()


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each added up in an order that depends on the length alone: equal vectors score the same."""
    return (x * q).sum(-1)


class Best:
    """The ``k`` best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.q_ids, self.q, self.k = ids, x, k
        self.ids = np.full((len(ids), k), np.iinfo("i8").max)
        self.scores = np.full((len(ids), k), -np.inf)

    def add(self, at: slice, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates (query x any number) of the queries ``at``; an id of the largest number is none."""
        none = (ids == self.q_ids[at, None]) | (ids == np.iinfo("i8").max)
        ids, scores = np.hstack([self.ids[at], ids]), np.hstack([self.scores[at], np.where(none, -np.inf, scores)])
        order = np.lexsort((-scores, ids), axis=1)  # an id takes one place, at its best score
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
        order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.ids[at], self.scores[at] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def meet(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None, books: Codebooks | None) -> None:
        """All vectors of a block (in the order of their ids) met. Equal vectors are scanned once and stand for their
        k + 1 smallest ids."""
        _, first, which = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(which.ravel(), kind="stable")
        n = np.bincount(which.ravel())
        begin, most = np.cumsum(n) - n, min(int(n.max()), self.k + 1)
        nth = np.arange(most)
        names = np.where(nth < n[:, None], ids[by[np.minimum(begin[:, None] + nth, len(by) - 1)]], np.iinfo("i8").max)
        own = x[first]
        if codes is None:
            once = (np.diff(ids) > 0).all()  # with repeated ids, the first k + 1 vectors may be of fewer ids
            for j in range(len(self.q)):
                s = _exact(own, self.q[j])
                u = np.flatnonzero(s >= np.partition(s, -(self.k + 1))[-(self.k + 1)]) if once and len(s) > self.k + 1 else np.arange(len(s))
                self.add(slice(j, j + 1), names[u].reshape(1, -1), np.repeat(s[u], most)[None])
            return
        codes = np.ascontiguousarray(codes[first].T)
        subs, take = books.centres.shape[0], min(AGAIN, len(own))
        for c in range(0, len(self.q), CHUNK):
            q = self.q[c:c + CHUNK]
            products = np.einsum("qsd,skd->qsk", _pad(q).reshape(len(q), subs, 2), books.centres)
            tables = (products[:, 0::2, :, None] + products[:, 1::2, None, :]).reshape(len(q), subs // 2, 256)
            near = np.zeros((len(q), len(own)), "f4")
            for m in range(subs // 2):
                near += tables[:, m][:, codes[m]]
            pick = np.argpartition(-near, take - 1, axis=1)[:, :take]
            scores = _exact(own[pick], q[:, None, :])
            self.add(slice(c, c + len(q)), names[pick].reshape(len(q), -1), np.repeat(scores, most, axis=1))

    def rows(self) -> pa.RecordBatch:
        there = self.scores > -np.inf
        return pa.record_batch([pa.array(np.repeat(self.q_ids, there.sum(1))), pa.array(self.ids[there]), pa.array(self.scores[there])], ["query_id", "vec_id", "score"])


def _scan(sent: Broadcast, k: int):
    """Pairs of a block of queries and a block of codes; pairs of one block of queries come one after another, so its
    best are kept over all of them. (Were the order another, more rows would leave, but the same result.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, b""
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                q_ids = b.column(1)[r].as_py()
                array = lambda i, kind: np.frombuffer(b.column(i)[r].as_buffer(), kind)  # noqa: B023, E731
                if best is None or q_ids != now or best.q.shape[1] != dim:
                    if best is not None:
                        yield best.rows()
                    best, now = Best(np.frombuffer(q_ids, "i8"), array(2, "f8").reshape(-1, dim).copy(), k), q_ids
                ids = array(3, "i8")
                codes = array(5, "u1").reshape(len(ids), -1) if b.column(5)[r].is_valid else None
                best.meet(ids, array(4, "f8").reshape(-1, dim), codes, sent.value.get(dim))
        if best is not None:
            yield best.rows()

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each vector whose id ``every`` divides with the ``k`` largest inner products of
    other ids, in double precision, largest first; ties go to the smaller id.

    Every row is a candidate, however often its vector occurs; all rows of a query's own id are passed over. Ids are meant to
    be distinct. One that comes with several vectors takes one place of a list, with the best score found, and as a query it
    has one list: the best scores that any of its vectors gives. Vectors of another length than the query's are no candidates of
    it. Null, empty, zero and non-finite vectors, and rows with a null id, take no part. An empty table gives an empty
    one; other columns, whatever their names, are not looked at. Candidates are proposed from codes, so single ones can be
    missed; vectors of a length that is too rare for codebooks are all scored.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    asked = F.col("vec_id") % every == 0
    size = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("asked"), F.coalesce(F.min("dim"), F.lit(1)).alias("dim")).first()
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(codebooks(rows, size.n, sample))  # 32 numbers a dimension and length
    blocks = size.n // block_rows(size.dim) + 1
    groups = max(-(-size.n // GROUP), min(blocks, 2 * parts(rows)), 1)
    spread = max(blocks, spark.sparkContext.defaultParallelism)
    codes = rows.coalesce(spread).mapInArrow(_codes(sent, groups), "dim int, g int, ids binary, vecs binary, codes binary")
    queries = rows.where(asked).coalesce(size.asked // QUERIES + 1).mapInArrow(_packed(_questions, ["dim", "q_ids", "q"], lambda dim: QUERIES), "dim int, q_ids binary, q binary")
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # the merge join streams its left side: each block of queries meets the blocks of a group one after another
    pairs = queries.hint("merge").join(codes, ["dim", "g"]).select("dim", "q_ids", "q", "ids", "vecs", "codes")
    found = pairs.mapInArrow(_scan(sent, k), "query_id bigint, vec_id bigint, score double").repartition("query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a query id's vectors, one list
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
