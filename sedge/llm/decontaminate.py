"""Benchmark decontamination: passages of a document within an edit budget of a benchmark item.

An item of n characters may differ by n // 16 edits (one of fewer than 24 by none, and it must stand as whole words). It
is cut into one piece more than that, so at least one piece stands unchanged in any such passage. An Aho-Corasick automaton finds the pieces in whole documents; around each hit
Myers' bit-parallel algorithm takes the item's least distance to any part of the window. Texts are compared in lower
case with every run of other characters than letters and digits as one blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import fresh, slices

#: Characters of an item, once normalised, for each edit allowed. An item too short for one edit is looked for as whole
#: words, between blanks or the text's ends.
CHARS_PER_EDIT = 16
#: Bytes of benchmark text that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_BYTES = 8_000_000

OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def pieces_of(item: str, edits: int) -> list[tuple[int, str]]:
    """(start, piece): the item in edits + 1 pieces of nearly one length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to any substring of ``text``, and where the first ends."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score, best, at = full, 0, size, size, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        xv = eq | mv
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Finder:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        short = [len(t) < chars_per_edit for _, t in items]
        own = [(i, f" {t} " if s else t, s) for (i, t), s in zip(items, short, strict=True)]
        self.items = [(i, t, 0 if s else len(t) // chars_per_edit, masks_of(t), s) for i, t, s in own]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits, _, _) in enumerate(self.items):
            for start, piece in pieces_of(text, edits):
                at.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item's id, distance, end in the normal text) for each item within its budget: the best place, first of ties."""
        text = f" {text} "
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(text) if self.any else ():
            for n, start in where:
                origin = end - size + 1 - start  # where the item would begin
                if (n, origin) in tried:
                    continue
                tried.add((n, origin))
                _, item, edits, masks, _ = self.items[n]
                old = best.get(n)
                if text.startswith(item, max(0, origin)) and origin >= 0:
                    found = (0, origin + len(item))
                elif old and old[0] == 0:
                    continue
                else:
                    low = max(0, origin - edits)
                    d, e = least_distance(masks, len(item), text[low:origin + len(item) + edits])
                    found = (d, low + e)
                if found[0] <= edits and (old is None or found < old):
                    best[n] = found
        return [(self.items[n][0], d, e - 1 - self.items[n][4]) for n, (d, e) in best.items()]


def masks_of(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


_finders: dict[int, Finder] = {}


def _search(sent: Broadcast, chars_per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent.value["key"]
        if key not in _finders:
            _finders.clear()
            _finders[key] = Finder(sent.value["items"], chars_per_edit)
        finder = _finders[key]
        for b in slices(batches):
            rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in finder.find(normal(t))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "ends_at"])

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, ends_at): each document's items found within their budget, with the least distance.

    A row for each pair of a document row and an item row, so repeated rows repeat; of an item's equally near places the
    first one counts. Null or empty texts match nothing, nor do items without a letter or digit; a null id stays null; a
    document without a leak has no row; either table may be empty. Texts of any length are searched whole. Other columns,
    whatever their names, are not looked at. The benchmark is taken in blocks of about ``block_bytes``, each broadcast,
    whatever its full size.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    test = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = None
    for k in range(blocks):
        rows = test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        kept = [(r.item_id, t) for r in rows if (t := normal(r.text))]
        sent = spark.sparkContext.broadcast({"key": hash((k, blocks, tuple(kept))), "items": kept})
        found = own.mapInArrow(_search(sent, chars_per_edit), "doc_id bigint, item_id bigint, distance bigint, ends_at bigint")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose text holds an item; every other row stays, with a null id or text too.

    Texts decide, not ids: rows are matched by xxhash64 of the text, which is null-safe, so repeated rows fare alike. All
    columns come back under their names; an empty table gives an empty one.
    """
    mine, theirs = fresh("_key", docs), fresh("_leak", docs)
    keyed = docs.withColumn(mine, F.xxhash64(F.col(f"`{text_col}`")))
    found = leaks(keyed, items, mine, text_col, **how).select(F.col("doc_id").alias(theirs)).distinct()
    return keyed.join(found, F.col(mine) == F.col(theirs), "left_anti").drop(mine)
