"""Toxicity by weak supervision.

Many voters, each a lexicon or a pattern, look at a document and vote or not. Some lexicons are fixed; others are
learned: words and word beginnings that labelled documents of one class use far more often, dealt out to several
voters. A generative model of hidden class and votes, fitted by expectation maximisation on the counts of vote patterns,
estimates the voters' accuracies and, along a tree, their correlations given the class. Its posterior labels, and nothing
else, are what a linear classifier over word and beginning features learns to score; true labels choose the learned
lexicons and the rate of the toxic class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import cut, slices, without

#: Bound on the labelled documents whose texts are learned from (a sample by hash of the id, where there are more).
SAMPLE = 20_000
#: Features of the classifier at most.
FEATURES = 4000
#: Fixed lexicons, a voter each.
LEXICONS = (
    ("idiot", "idiots", "moron", "morons", "imbecile", "dumb", "dumbass", "retard", "stupid", "fool"),
    ("loser", "losers", "pathetic", "worthless", "useless", "failure", "nobody", "coward"),
    ("trash", "garbage", "scum", "filth", "vermin", "parasite", "swine"),
    ("clown", "freak", "creep", "weirdo", "ugly", "disgusting", "repulsive"),
    ("hate", "hateful", "despise", "loathe", "detest", "contempt"),
    ("shit", "fuck", "fucking", "bitch", "bastard", "asshole", "cunt"),
)
#: Fixed patterns, a voter each: address followed by abuse, shouting, masked letters.
PATTERNS = (r"(?i)\byou(?:'re| are)? (?:\w+ )?(?:idiot|moron|stupid|pathetic|worthless|loser|trash|scum)\b", r"(?i)\bshut up\b|\bgo to hell\b", r"!{3,}", r"(?i)\b[a-z]+[*@#$]{1,3}[a-z]+\b")
LEARNED_VOTERS = 7
#: Share of all documents that the rates of correlated voters are drawn to their own by.
SHRINK = 0.003
STARTS = (4, 5, 6)
WORD = regex.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Distinct words, and their beginnings marked by a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in STARTS if len(w) > n}


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256):
        n: dict[str, list[int]] = {}
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for f in features_of(text):
                n.setdefault(f, [0, 0])[toxic] += 1
        if n:
            yield pa.record_batch([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["feature", "clean", "toxic"])


class Voters:
    def __init__(self, learned: list[frozenset]):
        self.lexicons = [frozenset(x) for x in LEXICONS] + learned
        self.patterns = [regex.compile(p) for p in PATTERNS]

    def votes(self, text: str | None, features: set[str]) -> list[int]:
        return [int(not features.isdisjoint(x)) for x in self.lexicons] + [int(bool(p.search(text or ""))) for p in self.patterns]


@dataclass
class Votes:
    """P(votes | class): a tree over the voters, each voting by the class and by its parent's vote."""

    parent: np.ndarray  # -1: none
    rates: np.ndarray  # voter x parent's vote x class: how often it votes

    def logs(self, patterns: np.ndarray) -> np.ndarray:
        """pattern x class: the log of the probability of each row of votes."""
        v = patterns.astype(int)
        above = np.where(self.parent[None] < 0, 0, v[:, np.maximum(self.parent, 0)])
        r = self.rates[np.arange(v.shape[1])[None], above]
        return np.log(np.where(v[:, :, None] == 1, r, 1 - r)).sum(1)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    learned: list[frozenset]
    votes: Votes | None
    vote_weights: np.ndarray


def _joint(v: np.ndarray, share: np.ndarray, post: np.ndarray) -> np.ndarray:
    """class x voter x voter x 2 x 2: how often two voters vote so, given the class."""
    out = []
    for w in (share * (1 - post), share * post):
        both, one, all_ = v.T @ (w[:, None] * v), w @ v, w.sum()
        only = one[:, None] - both
        out.append(np.stack([np.stack([all_ - one[:, None] - only.T, only.T], -1), np.stack([only, both], -1)], -2))
    return np.maximum(np.array(out), 0) + 1e-6


def _forest(joint: np.ndarray, documents: float) -> np.ndarray:
    """Each voter's parent in the spanning forest of the most mutual information that the class leaves between voters;
    only what pays for its two further rates (by the Bayesian criterion) makes a link."""
    p = joint / joint.sum((0, 3, 4), keepdims=True)
    each = p.sum((3, 4), keepdims=True)
    info = (p * np.log(p * each / p.sum(4, keepdims=True) / p.sum(3, keepdims=True))).sum((0, 3, 4)) - np.log(documents) / documents
    n = len(info)
    parent, best, by, left = np.full(n, -1), np.zeros(n), np.full(n, -1), list(range(n))
    while left:
        j = max(left, key=lambda x: (best[x], -x))
        parent[j] = by[j]
        left.remove(j)
        nearer = info[j] > best
        best[nearer], by[nearer] = info[j][nearer], j
    return parent


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, start: np.ndarray, rounds: int = 60) -> tuple[Votes, np.ndarray]:
    """The generative model of class and votes, and each pattern's posterior of being toxic.

    Expectation maximisation from ``start`` (a first guess of the posteriors) under a given ``prior``. Each voter has its
    rates given the class and, in a forest of the correlations that the class does not explain, given its parent's vote
    too; those are drawn towards the rates given the class alone, as if SHRINK of all documents said so. The forest is
    chosen anew in the first half of the rounds and then stays. A voter that repeats another so adds next to nothing.
    ``patterns``: distinct rows of votes; ``counts``: how often each occurs.
    """
    v, total, post = patterns.astype(float), counts.sum(), start
    share, own = counts / total, np.arange(patterns.shape[1])
    for step in range(rounds):
        joint = _joint(v, share, post)
        if step <= rounds // 2:
            parent = _forest(joint, total)
        at = joint[:, own, np.where(parent < 0, own, parent)]  # class, voter, its vote, its parent's
        free = ((at[:, :, 1].sum(-1) + 0.5 / total) / (at.sum((2, 3)) + 1 / total))[:, :, None].repeat(2, 2)
        tied = (at[:, :, 1] + SHRINK * free) / (at.sum(2) + SHRINK)
        model = Votes(parent, np.clip(np.where((parent < 0)[None, :, None], free, tied), 1e-5, 1 - 1e-5).transpose(1, 2, 0))
        logs = model.logs(patterns)
        odds = np.log(prior / (1 - prior)) + logs[:, 1] - logs[:, 0]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return model, post


def told_apart(strong: list[str], counts: dict[str, tuple[int, int]]) -> list[str]:
    """``strong`` without the words and beginnings that occur just as often as an earlier one that they continue or begin:
    these would be the same voice twice."""
    out: list[str] = []
    seen: dict[tuple, list[str]] = {}
    for f in strong:
        same = seen.setdefault(counts[f], [])
        if not any(g.rstrip("*").startswith(f.rstrip("*")) or f.rstrip("*").startswith(g.rstrip("*")) for g in same):
            out.append(f)
            same.append(f)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, max_features: int = FEATURES) -> Model:
    """Learn from the documents that ``labels`` (doc_id, toxic) covers, at most about ``sample`` of them.

    Null labels are left out; a repeated id takes its largest label, and so does a repeated text, which counts once. Texts
    are read whole; null ones have no features. Features of equal worth are taken in the order of their names. With no
    toxic or no clean example, as in empty tables, every document scores low. Other columns are not looked at.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.count()
    some = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 53)) < int((1 << 53) * min(1.0, sample / max(n, 1))))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    rows = cut(own.join(F.broadcast(some), "_id").select("toxic", "text").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"))  # copies count once
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean or not toxic:
        return Model({}, -2.0, [frozenset()] * LEARNED_VOTERS, None, np.zeros(0))
    counts = rows.mapInArrow(_presence, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    gain = F.col("toxic") / toxic * weight - F.col("clean") / clean * weight
    best = counts.where(F.col("toxic") + F.col("clean") >= 3).withColumn("gain", gain).withColumn("weight", weight)
    chosen = best.orderBy(F.desc("gain"), "feature").limit(max_features).collect()
    strong = [r.feature for r in chosen if r.weight > 3.0 and r.toxic >= 5][:240]
    strong = told_apart(strong, {r.feature: (r.clean, r.toxic) for r in chosen})
    learned = [frozenset(strong[i::LEARNED_VOTERS]) for i in range(LEARNED_VOTERS)]
    places = {r.feature: i for i, r in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(learned)
        for b in slices(batches, 1024):
            votes, at = [], []
            for text in b.column(1).to_pylist():  # one text's features at a time
                f = features_of(text)
                votes.append(voters.votes(text, f))
                at.append(sorted(places[x] for x in f if x in places))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int8())), pa.array(at, pa.list_(pa.int32()))], ["votes", "at"])

    data = rows.mapInArrow(vectors, "votes array<tinyint>, at array<int>").toArrow()  # bounded by the sample
    votes = np.array(data.column("votes").to_pylist(), "i1")
    patterns, which, n_of = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    which, prior = which.reshape(-1), min(max(toxic / (toxic + clean), 0.001), 0.999)
    told, post = label_model(patterns, n_of, prior, np.where(patterns.sum(1) > 1, 0.9, np.where(patterns.any(1), 0.3, 0.01)))
    y = post[which]
    lists = data.column("at").to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.concatenate([np.array(x, "i8") for x in lists])
    w, vote_w, bias = train_linear(row, col, votes.astype(float), y, len(chosen))
    return Model({f: float(w[i]) for f, i in places.items() if w[i]}, bias, learned, told, vote_w)


def train_linear(row: np.ndarray, col: np.ndarray, votes: np.ndarray, y: np.ndarray, size: int, rounds: int = 800, rate: float = 1.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on probabilities, by gradient steps with per-weight scaling."""
    n, k = votes.shape
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))  # long texts hold more features
    w, v, b = np.zeros(size), np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    gw, gv, gb = np.full(size, 1e-8), np.full(k, 1e-8), 1e-8
    for _ in range(rounds):
        z = scale * np.bincount(row, weights=w[col], minlength=n) + votes @ v + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        dw = np.bincount(col, weights=(e * scale)[row], minlength=size) / n + decay * w
        dv, db = votes.T @ e / n + decay * v, e.mean()
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        w, v, b = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), b - rate * db / np.sqrt(gb)
    return w, v, float(b)


def _score(sent: Broadcast, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        voters = Voters(m.learned)
        weights = m.weights
        for b in slices(batches):
            scores = []
            for text in b.column(text_at).to_pylist():
                f = features_of(text)
                hit = [weights[x] for x in f if x in weights]
                z = m.bias + sum(sorted(hit)) / np.sqrt(max(len(hit), 1))  # sorted: the sum is the same in any order
                if len(m.vote_weights):
                    z += float(np.dot(voters.votes(text, f), m.vote_weights))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "toxicity"])

    return run


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) added, in place of a column of that name; null and empty texts score as texts
    without features, and equal texts alike. An empty table gives an empty one. No shuffle; texts are read whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_features
    own = without(docs, "toxicity")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    at = [c.lower() for c in own.columns].index(text_col.lower())
    return own.mapInArrow(_score(sent, at), f"{kinds}, toxicity double")
