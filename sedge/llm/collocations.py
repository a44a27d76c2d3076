"""Phrases of several words that stand together more often than their parts explain.

Texts of a language are packed into shards where they are read. A shard's words become ids, its suffixes are ordered by
prefix doubling on those ids, and the intervals of the table of longest common prefixes are its n-grams with their counts.
Counts of all shards meet by key.

Most n-grams of a corpus occur once, so they are not all sent: words are counted first, then pairs of frequent words (as
64-bit hashes), then, by text, the pairs that may be frequent and the longer n-grams all of whose pairs may be. What may be
frequent is a bitmap of hashes of bounded size: a hash that collides costs a row, never a result, as the last counts are by
text and every n-gram that reaches the threshold passes (its parts are at least as frequent).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import cut

#: Bytes of text in a shard, and in all shards that a task holds at a time.
SHARD, HELD = 8 << 20, 24 << 20
#: Bits of the bitmap for each frequent n-gram, and the logarithms of the fewest and most bits that it has (32 MB).
SPARSE, FEWEST, MOST = 16, 16, 28
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, and every character that ends a piece to a full stop.
TABLE = bytes(ord(".") if i in BREAKS else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Word ids of a text, 0 where a piece ends, and the words (that of id 0 is the full stop)."""
    spaced = b". " + text.translate(TABLE).replace(b".", b" . ")
    # white space that ends pieces is gone by now, so blanks and tabs are all that is split at
    words = pc.ascii_split_whitespace(pa.array([spaced], pa.large_binary()).cast(pa.large_string())).values
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()


def suffix_array(ids: np.ndarray, words: int) -> np.ndarray:
    """Suffixes in an order by their first ``words`` ids, by prefix doubling: ranks by h ids give ranks by 2 h."""
    rank, h = ids.astype("i8"), 1
    order = np.argsort(rank)
    while h < words:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key)
        now = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.r_[0, now[1:] != now[:-1]])
        h *= 2
    return order


def ngrams(ids: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, a place of each, counts) of the n-grams of ``least`` to ``most`` words; id 0 ends a piece.

    Neighbours in suffix order share as many words as the table of longest common prefixes says; the suffixes between two
    places with less than n are the occurrences of one n-gram.
    """
    order = suffix_array(ids, most)
    padded = np.r_[ids, np.zeros(most, ids.dtype)]
    ends = np.flatnonzero(padded == 0)
    room = np.minimum(ends[np.searchsorted(ends, order)] - order, most)  # words up to the end of the piece
    prefix = np.zeros(len(order), "i4")
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(most):
        same &= (padded[order[1:] + k] == padded[order[:-1] + k]) & (room[1:] > k)
        prefix[1:] += same
    for n in range(least, most + 1):
        begin = np.flatnonzero(prefix < n)
        count = np.diff(np.r_[begin, len(order)])
        there = room[begin] >= n
        yield n, order[begin[there]], count[there]


def runs(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The ids of runs of linked neighbours (``linked[i]``: i and i + 1), a 0 after each; all else is left out."""
    first = np.r_[linked, False]
    inside = first | np.r_[False, linked]
    last = np.flatnonzero(inside & ~first)
    return np.insert(ids[inside], np.cumsum(inside)[last], 0)


def mixed(*hashes: np.ndarray) -> np.ndarray:
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def hashes_of(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), "u8", len(words))


def hits(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap holds; their upper bits are the place."""
    place = hashes >> np.uint64(64 - int(len(bits) * 64).bit_length() + 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sharded(work):
    """``work(lang, text)`` over shards of rows (lang, text); it yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 64
                if size[lang] > SHARD:
                    del size[lang]
                    yield from work(lang, b".".join(held.pop(lang)))
                while sum(size.values()) > HELD:  # many languages: the fullest goes
                    fullest = max(size, key=size.get)
                    del size[fullest]
                    yield from work(fullest, b".".join(held.pop(fullest)))
        for lang in list(held):
            yield from work(lang, b".".join(held.pop(lang)))

    return run


def _words(lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
    ids, words = words_of(text)
    n = np.bincount(ids, minlength=len(words))
    yield pa.record_batch([pa.array([lang] * (len(words) - 1), pa.string()), pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(hashes_of(lang, words)[1:].view("i8")), pa.array(n[1:])], ["lang", "phrase", "h", "n"])


def _linked_words(lang: str, text: bytes, bits: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids of the runs of frequent words, the words and their hashes."""
    ids, words = words_of(text)
    h = hashes_of(lang, words)
    good = hits(h, bits)
    good[0] = False
    return runs(ids, good[ids[:-1]] & good[ids[1:]]), words, h


def _pairs(frequent: Broadcast):
    def work(lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        ids, _, h = _linked_words(lang, text, frequent.value)
        for _, at, n in ngrams(ids, 2, 2):
            yield pa.record_batch([pa.array(mixed(h[ids[at]], h[ids[at + 1]]).view("i8")), pa.array(n)], ["h", "n"])

    return _sharded(work)


def _phrases(frequent: Broadcast, pairs: Broadcast, most: int):
    def work(lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        ids, words, h = _linked_words(lang, text, frequent.value)
        if not len(ids):
            return
        good = (ids[:-1] > 0) & (ids[1:] > 0)
        good[good] = hits(mixed(h[ids[:-1][good]], h[ids[1:][good]]), pairs.value)
        ids = runs(ids, good)
        names = pa.array(words, pa.binary()).cast(pa.string())
        for k, at, n in ngrams(ids, 2, most):
            phrase = pc.binary_join_element_wise(*[names.take(pa.array(ids[at + j])) for j in range(k)], " ")
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), k, "i4")), phrase, pa.array(n)], ["lang", "k", "phrase", "n"])

    return _sharded(work)


def bitmap(hashes: DataFrame) -> Broadcast:
    """The bitmap of a column ``h`` of distinct hashes, broadcast: 16 bits for each, 32 MB at most whatever their number."""
    n = hashes.count()
    log = min(max((SPARSE * n).bit_length(), FEWEST), MOST)
    place = F.shiftrightunsigned("h", 64 - log)
    words = hashes.select(place.alias("p")).selectExpr("shiftrightunsigned(p, 6) as at", "shiftleft(1L, cast(p & 63 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (log - 6), "i8")
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits.view("u8"))


def phrase_counts(docs: DataFrame, least: int = 30, most: int = 4, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n): every phrase of 1 to ``most`` words with ``least`` occurrences or more; and (lang, n): all
    occurrences of words."""
    src = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    words = cut(src.mapInArrow(_sharded(_words), "lang string, phrase string, h bigint, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("h").alias("h")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    one = bitmap(frequent.select("h").distinct())
    pairs = cut(src.mapInArrow(_pairs(one), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"))
    longer = src.mapInArrow(_phrases(one, bitmap(pairs), most), "lang string, k int, phrase string, n bigint").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return cut(frequent.select("lang", F.lit(1).alias("k"), "phrase", "n").unionByName(longer)), totals


def part(phrase: str, begin, length):
    return F.array_join(F.slice(phrase, begin, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the phrases of two words and more: the cut into two parts that scores lowest,
    ties to the shorter first part. ``counts`` must hold every part of each phrase. Arithmetic is in decimals."""
    ws = counts.where("k > 1").withColumn("ws", F.split("phrase", " "))
    cuts = ws.withColumn("j", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("first", part("ws", F.lit(1), F.col("j"))).withColumn("rest", part("ws", F.col("j") + 1, F.col("k") - F.col("j")))
    named = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(named("first", "l"), ["lang", "first"]).join(named("rest", "r"), ["lang", "rest"])
    score = F.expr("cast((cast(2000000 as decimal(8,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "k", F.col("n").alias("a")).agg(F.min(F.struct("score", "j", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "k", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, counts: DataFrame, percent: int = 80) -> DataFrame:
    """``phrases`` (lang, phrase, a, ...) without those inside a longer one that has ``percent`` of their count or more."""
    inner = counts.where("k > 2").withColumn("ws", F.split("phrase", " ")).withColumn("m", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("i", F.explode(F.expr("sequence(1, k - m + 1)")))
    over = inner.groupBy("lang", part("ws", F.col("i"), F.col("m")).alias("phrase")).agg(F.max("n").alias("over"))
    kept = phrases.join(over, ["lang", "phrase"], "left")
    return kept.where(f"over is null or cast(100 as decimal(3,0)) * cast(over as decimal(19,0)) < cast({int(percent)} as decimal(9,0)) * cast(a as decimal(19,0))").drop("over")


def collocations(docs: DataFrame, least: int = 30, most: int = 4, top: int = 2000, percent: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most`` words.

    Letters A-Z count as lower case; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. ``a`` counts a
    phrase's occurrences, overlaps included, ``l`` and ``r`` those of the parts of its lowest-scoring cut, ``n`` all words
    of the language; the score is floor(2,000,000 a / (l + r)). Phrases occur ``least`` times or more, and those inside a
    longer one with ``percent`` of their count or more are dropped. Order: score, then ``a``, both falling, then the phrase
    by its bytes. A null language is ``und``, a null text an empty one without words; texts are taken whole, whatever their
    length; repeated rows count each; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    counts, totals = phrase_counts(docs, least, most, text_col, lang_col)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = uncovered(scored(counts), counts, percent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest(range(1, least(4, len(ws) - i + 1) + 1)) AS k FROM s),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE n >= 30),
x AS (SELECT *, unnest(range(1, k)) AS j FROM c WHERE k > 1),
y AS (SELECT x.lang, x.phrase, x.k, x.n AS a, j, u.n AS l, v.n AS r, ((2000000::HUGEINT * x.n) // (u.n::HUGEINT + v.n))::BIGINT AS score
  FROM x JOIN c u ON u.lang = x.lang AND u.phrase = array_to_string(x.ws[1:j], ' ') JOIN c v ON v.lang = x.lang AND v.phrase = array_to_string(x.ws[j + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, k, n, ws, unnest(range(2, k)) AS m FROM c WHERE k > 2),
o AS (SELECT lang, array_to_string(ws[b:b + m - 1], ' ') AS phrase, max(n) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS b FROM i) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, encode(z.phrase)) AS rank FROM z LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT q.lang, rank, q.phrase, a, l, r, t.n, score FROM q JOIN t USING (lang) WHERE rank <= 2000"""
