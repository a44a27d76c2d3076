"""Language identification of mixed texts.

A word's script narrows the languages that it may be in; hashed trigrams of its bytes score those. Viterbi over a
document's words, with a penalty for each switch, then labels spans. A bound shows for most documents that staying in one
language is best; the others of a batch step through their words together, so each step is one array operation. Counts
cover every training document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import slices

#: Hash buckets for n-grams, for each language.
BITS = 16
BUCKETS = 1 << BITS
#: Cost, in nats, of a language switch between two words.
SWITCH = 8.0
#: Words that are worked on at once.
WORDS = 200_000
#: A language may use a script if so large a share of its training words does.
SHARE = 0.002
#: Script ranges by the first letter's code point (start, end, script), in order.
RANGES = ((0x41, 0x24F, 0), (0x370, 0x3FF, 1), (0x400, 0x52F, 2), (0x530, 0x58F, 3), (0x590, 0x5FF, 4), (0x600, 0x77F, 5), (0x900, 0x97F, 6), (0x980, 0x9FF, 7), (0xB80, 0xBFF, 8), (0xE00, 0xE7F, 9), (0x10A0, 0x10FF, 10), (0x1E00, 0x1EFF, 0), (0x1F00, 0x1FFF, 1), (0x3040, 0x30FF, 11), (0x3400, 0x9FFF, 12), (0xAC00, 0xD7AF, 13))
OTHER, SCRIPTS = 14, 15
STARTS, ENDS, KINDS = (np.array(x) for x in zip(*RANGES, strict=True))
LETTERS = re.compile(r"[^\W\d_]+")


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    x = np.array([ord(w[0]) for w in words], "i8")
    at = np.maximum(np.searchsorted(STARTS, x, side="right") - 1, 0)
    return np.where((STARTS[at] <= x) & (x <= ENDS[at]), KINDS[at], OTHER)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): the bucket of each trigram of bytes of the words, edges marked, and where each word's begin."""
    raw = np.frombuffer(("<" + "<".join(words) + "<").encode("utf-8", "replace"), "u1").astype("u4")
    edge = np.flatnonzero(raw == 60)
    h = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    inside = np.ones(len(h), bool)
    inside[edge[1:-1] - 1] = False  # a trigram must not reach into the next word
    return h[inside].astype("i8"), edge[:-1] - np.arange(len(words))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): summed over the task; buckets from BUCKETS on count the words of each script."""
    total: dict[str, np.ndarray] = {}
    seen: dict[str, list[str]] = {}

    def counted() -> None:
        for lang, words in seen.items():
            n = total.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, "i8"))
            for i in range(0, len(words), WORDS):
                some = words[i:i + WORDS]
                n[:BUCKETS] += np.bincount(grams(some)[0], minlength=BUCKETS)
                n[BUCKETS:] += np.bincount(scripts_of(some), minlength=SCRIPTS)
        seen.clear()

    held = 0
    for b in slices(batches, 256):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_of(text)
            seen.setdefault(lang, []).extend(words)
            held += len(words)
            if held > WORDS:
                counted()
                held = 0
    counted()
    for lang, n in total.items():
        own = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(own.astype("i4")), pa.array(n[own])], ["lang", "bucket", "n"])


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # bucket x language
    scripts: np.ndarray  # script x language: whether it may be


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows with a language: BUCKETS counts a language reach the driver, however long the corpus is."""
    own = train.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = own.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = rows.column("lang").to_pylist()
    langs = sorted(set(names))
    n = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    n[rows.column("bucket").to_numpy(), [place[x] for x in names]] = rows.column("n").to_numpy()
    gram, script = n[:BUCKETS], n[BUCKETS:]
    logs = np.log((gram + 0.5) / (gram.sum(0) + 0.5 * BUCKETS)).astype("f4")
    may = script >= SHARE * np.maximum(1, script.sum(0))
    may[~may.any(1)] = True  # a script that no language uses narrows nothing
    return Model(langs, logs, may)


def scores_of(words: list[str], model: Model) -> np.ndarray:
    """word x language scores (0 for the best, twelve nats below at worst), with a large cost for a language that does
    not use the word's script."""
    if not words:
        return np.zeros((0, len(model.langs)), "f4")
    bucket, first = grams(words)
    s = np.add.reduceat(model.logs[bucket], first, axis=0)
    return np.maximum(s - s.max(1, keepdims=True), -12.0) - np.float32(30.0) * ~model.scripts[scripts_of(words)]


def constant(s: np.ndarray, switch: float) -> int | None:
    """The language c in which a whole document is best labelled, if bounds show that.

    No run of words gains more than one switch by any other language, so a path that has c anywhere gains nothing from
    leaving it; and always taking the best other language loses in all, so a path without c gains nothing either.
    """
    c = int(s.sum(0, dtype="f8").argmax())
    d = s.astype("f8") - s[:, c:c + 1]
    if s.shape[1] == 1:
        return 0
    if np.delete(d, c, 1).max(1).sum() > 0:
        return None
    run = np.cumsum(d, 0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, d.shape[1])), run[:-1]]), 0)
    return c if (run - low).max() <= switch else None


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each document; ties take the smaller index, and staying before switching."""
    paths: list[np.ndarray] = [np.zeros(len(s), "i2") for s in scores]
    order = []
    for i, s in enumerate(scores):
        if len(s):
            c = constant(s, switch)
            if c is None:
                order.append(i)
            else:
                paths[i][:] = c
    order.sort(key=lambda i: -len(scores[i]))
    if not order:
        return paths
    size = np.array([len(scores[i]) for i in order])
    base = np.concatenate([scores[i] for i in order])
    first = np.cumsum(size) - size
    now = base[first].copy()
    back, ends = [], {}
    longer = len(size) - np.cumsum(np.bincount(size, minlength=int(size[0]) + 1))  # by t: documents of more than t words
    for t in range(1, int(size[0]) + 1):
        k = int(longer[t])
        if k < len(now):
            ends.update((j, int(now[j].argmax())) for j in range(k, len(now)))
            now = now[:k]
        if not k:
            break
        best = now.argmax(1)
        over = now[np.arange(k), best] - switch
        jump = over[:, None] > now
        back.append(np.where(jump, best[:, None], np.arange(now.shape[1])[None, :]).astype("i2"))
        now = np.maximum(now, over[:, None]) + base[first[:k] + t]
    for j, i in enumerate(order):
        path = paths[i]
        state = ends[j]
        for t in range(int(size[j]) - 1, 0, -1):
            path[t] = state
            state = int(back[t - 1][j, state])
        path[0] = state
    return paths


def _label(sent: Broadcast, switch: float, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in slices(batches, 1024):
            held: list[tuple] = []
            size = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                held.append((i, words, any(c.isalpha() for w in words for c in w)))
                size += len(words)
                if size > WORDS:
                    yield out(held, model)
                    held, size = [], 0
            if held:
                yield out(held, model)

    def out(held: list[tuple], model: Model) -> pa.RecordBatch:
        rows, langs = [], model.langs
        scored = scores_of([x for _, w, _ in held for x in w], model) if langs else np.zeros((0, 0))
        cuts = np.cumsum([len(w) for _, w, _ in held])[:-1]
        for (i, words, letters), path in zip(held, viterbi(np.split(scored, cuts), switch) if langs else [()] * len(held), strict=True):
            if not letters or not words or not langs:
                rows.append((i, "und", 0.0, []))
                continue
            mass = np.bincount(path, weights=[len(w) for w in words], minlength=len(langs))
            best = int(mass.argmax())
            spans = []
            if with_spans:
                at = 0
                for state, run_of in groupby(path.tolist()):
                    n = len(list(run_of))
                    spans.append({"start": at, "words": n, "lang": langs[state]})
                    at += n
            rows.append((i, langs[best], float(mass[best] / mass.sum()), spans))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.float64(), SPANS]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 3 + with_spans], ["doc_id", "lang_pred", "score", "spans"][: 3 + with_spans])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, spans), a row for each row.

    ``spans`` lists runs of words (start and number, words being runs of letters) in one language; lang_pred holds most
    letters, score is its share of them. Null, empty or letterless text: ``und``, score 0, no spans; so is every text
    where the model has learned no language. Of equal scores the language earlier in the alphabet counts. A null id stays
    null; repeated rows repeat; an empty table gives an empty one; other columns, whatever their names, are not looked at.
    No shuffle; long texts are labelled whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS numbers a language
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_label(sent, switch, with_spans), "doc_id bigint, lang_pred string, score double" + ", spans array<struct<start:int,words:int,lang:string>>" * with_spans)
