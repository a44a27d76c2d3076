"""Exact top-k search: tiles of vectors are multiplied with blocks of queries, each tile's best are selected, lists merge
in a tree.

Vectors are scaled to whole numbers, and a product of two tiles is taken in the narrowest type that is exact for it (by
the norms of both: single or double precision, else Python's integers). Tiles are packed where they are read, so vectors
are not shuffled one by one. Blocks of queries and tiles meet on a grid: a cell holds one group of queries and one group of
tiles, both of bounded size, so copies grow with the number of groups of the *other* side only. A cell keeps one list a
query; lists merge by eights, level by level, so no step gathers more than eight lists of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import cut

#: Bytes of a tile, counted in single precision, and tiles of a cell.
TILE_BYTES, TILES = 2 << 20, 16
#: Queries of a group, of which a chunk at a time has its products made.
QUERIES, CHUNK = 4096, 256
#: Lists of a query that one step of the tree merges.
FAN = 8
#: Whole numbers up to these are exact in single and double precision.
SINGLE, DOUBLE = 1 << 24, 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): rows with an id and a vector whose components are finite, also when scaled, as whole numbers."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    good = own.where("vec_id is not null and x is not null").withColumn("x", F.transform("x", lambda x: x * F.lit(float(scale))))
    return good.where("forall(x, y -> y is not null and not isnan(y) and abs(y) < double('infinity'))").select("vec_id", F.col("x").alias("vec"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed by length into tiles (dim, part, nth, n, ids, x); the components are floored here."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    nth = 0

    def done(dim: int) -> pa.RecordBatch:
        nonlocal nth
        ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
        nth += 1
        small = not x.size or np.abs(x).max() <= SINGLE
        row = {"dim": dim, "part": TaskContext.get().partitionId(), "nth": nth, "n": len(ids), "ids": ids.tobytes(), "x": x.astype("f4" if small else "f8").tobytes()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("nth", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("x", pa.binary())]))

    for b in batches:
        dims = np.diff(b.column(1).offsets.to_numpy())
        for dim in np.unique(dims).tolist():
            own = b.filter(pa.array(dims == dim))
            ids, x = own.column(0).to_numpy(), np.floor(np.asarray(own.column(1).flatten()).reshape(len(own), dim))
            most = max(64, TILE_BYTES // max(4 * dim, 8))
            for i in range(0, len(ids), most):
                if sum(len(c) for c, _ in held.get(dim, [])) + len(ids[i:i + most]) > most:
                    yield done(dim)
                held.setdefault(dim, []).append((ids[i:i + most], x[i:i + most]))
            while sum(8 * (d + 1) * sum(len(c) for c, _ in h) for d, h in held.items()) > 8 * TILE_BYTES:  # many lengths
                yield done(max(held, key=lambda d: (d + 1) * sum(len(c) for c, _ in held[d])))
    for dim in list(held):
        yield done(dim)


def _asked(every: int):
    """The queries among the rows of tiles, as tiles of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, x = unpacked(r)
                own = ids % every == 0
                if own.any():
                    yield pa.RecordBatch.from_pylist([r | {"n": int(own.sum()), "ids": ids[own].tobytes(), "x": x[own].tobytes()}], b.schema)

    return run


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "i8")
    size = len(row["x"]) // max(1, len(ids) * row["dim"])
    return ids, np.frombuffer(row["x"], "f8" if size == 8 else "f4").reshape(len(ids), row["dim"])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs, exact; those beyond a long count as its ends. By Cauchy and Schwarz no
    partial sum is larger than the product of the norms."""
    if not q.shape[1]:
        return np.zeros((len(q), len(x)), "i8")
    most = float(np.sqrt((q.astype("f8") ** 2).sum(1).max()) * np.sqrt((x.astype("f8") ** 2).sum(1).max())) * 1.01
    if most < DOUBLE:
        kind = "f4" if most < SINGLE else "f8"
        return (q.astype(kind) @ x.astype(kind).T).astype("i8")
    whole = [[int(v) for v in row] for row in q.tolist()], [[int(v) for v in row] for row in x.tolist()]
    return np.array([[min(max(sum(a * b for a, b in zip(u, v, strict=True)), LEAST), MOST) for v in whole[1]] for u in whole[0]], "i8").reshape(len(q), len(x))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's ``k`` largest scores, ties to the smaller id; ``ids`` ascend and are distinct."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        row, at = np.nonzero(scores >= least[:, None])
    else:
        row, at = np.indices(scores.shape).reshape(2, -1)
    score = scores[row, at]
    order = np.lexsort((at, -score.astype("f8"), row)) if not score.size or np.abs(score).max() < DOUBLE else np.array(sorted(range(len(row)), key=lambda i: (row[i], -int(score[i]), at[i])), int)
    row, at, score = row[order], at[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return row[keep], ids[at[keep]], score[keep]


def _search(k: int):
    """A cell: the group's queries against its tiles. An id that comes with several vectors counts by its best score."""

    def run(queries: pa.Table, tiles: pa.Table) -> pa.Table:
        rows: list[list[np.ndarray]] = [[], [], []]
        asked = [unpacked(r) for r in queries.select(["dim", "ids", "x"]).to_pylist()]
        for tile in (r for b in tiles.select(["dim", "ids", "x"]).to_batches(max_chunksize=1) for r in b.to_pylist()):
            ids, x = unpacked(tile)
            order = np.argsort(ids, kind="stable")
            names, begin = np.unique(ids[order], return_index=True)
            x = x[order]
            for q_ids, q in asked:
                for c in range(0, len(q), CHUNK):
                    scores = products(q[c:c + CHUNK], x)
                    if len(names) < len(ids):
                        scores = np.maximum.reduceat(scores, begin, axis=1)
                    own = q_ids[c:c + CHUNK]
                    # a query's own id is no candidate: one more place is kept, and its row is passed over
                    row, at, score = best_of(scores, names, k + 1)
                    other = at != own[row]
                    for held, new in zip(rows, (own[row[other]], at[other], score[other]), strict=True):
                        held.append(new)
        q_ids, ids, score = (np.concatenate(c) if c else np.zeros(0, "i8") for c in rows)
        order = np.lexsort((~score, ids, q_ids))
        q_ids, ids, score = q_ids[order], ids[order], score[order]
        new = np.r_[True, (q_ids[1:] != q_ids[:-1]) | (ids[1:] != ids[:-1])][:len(q_ids)]  # the best of each pair of ids
        order = np.lexsort((ids[new], ~score[new], q_ids[new]))
        q_ids, ids, score = q_ids[new][order], ids[new][order], score[new][order]
        keep = np.arange(len(q_ids)) - np.searchsorted(q_ids, q_ids) < k
        q_ids, ids, score = q_ids[keep], ids[keep], score[keep]
        who, begin = np.unique(q_ids, return_index=True)
        ends = pa.array(np.r_[begin, len(q_ids)].astype("i4"))
        cell = (queries if queries.num_rows else tiles).select(["r", "c"]).slice(0, 1).to_pylist()[0]
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(~score), pa.array(ids)], ["low", "id"]))
        return pa.table({"query_id": pa.array(who), "r": pa.array(np.full(len(who), cell["r"])), "node": pa.array(np.full(len(who), cell["c"])), "best": lists})

    return run


def merged(lists: DataFrame, k: int) -> DataFrame:
    """Lists (query_id, r, node, best) of one query and node joined to one list of its ``k`` best; an id counts once.
    Entries are (the score's complement, id), so the natural order is best first."""
    first = F.expr("filter(best, (x, i) -> not exists(slice(best, 1, i), y -> y.id = x.id))")
    whole = lists.groupBy("query_id", "r", "node").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    return whole.withColumn("best", F.slice(first, 1, k))


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each vector whose id ``every`` divides with the ``k`` largest inner products of
    other ids, largest first, ties to the smaller id; vectors are floor(scale * component) in double precision.

    Every row is a candidate, and results are exact. One list a query id: if several rows carry an id, as query or as
    candidate, each pair of ids counts once, by the best score of their rows; all rows of a query's own id are passed over.
    Vectors of another length than the query's are no candidates of it; vectors without components score 0 with one
    another. Rows with a null id, a null vector, or null or non-finite components (also once scaled) take no part. A score
    beyond 64 bits counts as the largest or smallest long. Fewer than ``k`` candidates give all of them; an empty table,
    or one without queries, gives no rows; other columns, whatever their names, are not looked at.
    """
    kinds = "dim int, part bigint, nth bigint, n bigint, ids binary, x binary"
    tiles = cut(usable(vectors, scale, id_col, vector_col).mapInArrow(_tiles, kinds))
    queries = tiles.mapInArrow(_asked(every), kinds)
    total = tiles.count()
    asked = queries.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    # groups of tiles, at least one for each core, and of queries
    c, r = max(1, -(-total // TILES), min(total, tiles.sparkSession.sparkContext.defaultParallelism)), max(1, -(-asked // QUERIES))
    spot = lambda n: F.pmod(F.xxhash64("part", "nth"), F.lit(n))  # noqa: E731  tiles are many and alike: groups are even
    left = queries.withColumn("r", spot(r)).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c - 1).cast("long"))))
    right = tiles.withColumn("c", spot(c)).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long"))))
    lists = left.groupBy("dim", "r", "c").cogroup(right.groupBy("dim", "r", "c")).applyInArrow(_search(k), "query_id bigint, r bigint, node bigint, best array<struct<low:bigint,id:bigint>>")
    while c > 1:
        c = -(-c // FAN)
        lists = merged(lists.withColumn("node", (F.col("node") / FAN).cast("long")), k)
    if r > 1:  # an id whose rows fell to several groups of queries; any other has one list here
        lists = merged(lists.withColumns({"r": F.lit(0).cast("long"), "node": F.lit(0).cast("long")}), k)
    found = lists.select("query_id", F.posexplode("best").alias("pos", "hit"))
    return found.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.expr("~hit.low").alias("score"))


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
