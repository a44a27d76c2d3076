"""Licence scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import raw, slices

#: Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that add a label of their own.
NOTICES = {
    "all rights reserved": "proprietary",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "licensed under the gpl": "gpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
#: What stands before a licence expression, which ends with its line.
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")


def family(name: str, versions: str, *ends: str) -> list[str]:
    """Identifiers of one family: its name, each version of it, and each version with each of ``ends``."""
    return [name, *(f"{name}-{v}{e}" for v in versions.split() for e in ("", *ends))]


GNU = ("-only", "-or-later", "+")
#: Identifiers by how freely work under them may be used again; others, and plain names, go by the start of their names
#: (see ``freedom``), and what has no known start gets UNKNOWN.
FREE: dict[float, list[str]] = {
    1.0: ["cc0", "cc0-1.0", "unlicense", "0bsd", "wtfpl", "public-domain", "mit-0"],
    0.95: ["mit", "isc", "bsd", *family("bsd", "1 2 3 4", "-clause", "-clause-patent", "-clause-clear"), "x11", "ncsa", "curl", "ntp", "postgresql", "hpnd", "bsl-1.0", "python-2.0", *family("psf", "2.0")],
    0.9: ["zlib", "libpng", *family("apache", "1.0 1.1 2.0"), *family("afl", "1.1 1.2 2.0 2.1 3.0"), *family("artistic", "1.0 2.0"), *family("ecl", "1.0 2.0"), *family("php", "3.0 3.01"), "mulanpsl-2.0"],
    0.85: [*family("cc-by", "1.0 2.0 2.5 3.0 4.0"), *family("odc-by", "1.0"), *family("ofl", "1.0 1.1")],
    0.6: [*family("mpl", "1.0 1.1 2.0", "-no-copyleft-exception"), *family("epl", "1.0 2.0"), *family("cddl", "1.0 1.1"), *family("cc-by-sa", "1.0 2.0 2.5 3.0 4.0"), *family("ms-pl", ""), *family("eupl", "1.0 1.1 1.2"), *family("odbl", "1.0"), *family("cpl", "1.0")],
    0.5: [*family("lgpl", "2.0 2.1 3.0", *GNU), *family("cecill", "1.0 2.0 2.1"), "cecill-c", "cecill-b"],
    0.35: [*family("gpl", "1.0 2.0 3.0", *GNU), *family("osl", "1.0 2.0 2.1 3.0"), *family("gfdl", "1.1 1.2 1.3", *GNU)],
    0.25: [*family("agpl", "1.0 3.0", *GNU), *family("sspl", "1.0")],
    0.2: [*family("cc-by-nc", "1.0 2.0 2.5 3.0 4.0"), *family("cc-by-nd", "1.0 2.0 2.5 3.0 4.0"), *family("cc-by-nc-sa", "1.0 2.0 2.5 3.0 4.0"), *family("cc-by-nc-nd", "1.0 2.0 2.5 3.0 4.0"), *family("polyform-noncommercial", "1.0.0"), *family("busl", "1.1")],
    0.0: ["proprietary", "licenseref-proprietary", "none"],
}
FREEDOM = {name: value for value, names in FREE.items() for name in names}
UNKNOWN = 0.5
LONGEST = max(map(len, FREEDOM))
#: What each kind of evidence adds to the score: a base phrase, another notice, a tag.
WEIGHTS = (0.6, 0.4, 0.9)
#: Words are runs of ASCII letters and digits and of all bytes of non-ASCII characters.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


@lru_cache(10_000)
def known(name: str) -> str | None:
    """The longest known identifier that a name is or continues after a hyphen, a dot or a plus."""
    at = len(name) if len(name) <= LONGEST else max(name.rfind(c, 0, LONGEST + 1) for c in "-.+")
    while at > 0 and (own := name[:at]) not in FREEDOM:
        at = max(own.rfind(c) for c in "-.+")
    return own if at > 0 else None


def freedom(name: str) -> float:
    """How freely work under a licence may be used again: the value of its known identifier, else UNKNOWN."""
    own = known(name)
    return UNKNOWN if own is None else FREEDOM[own]


#: Parts of an expression, and the line ends that end it.
TOKEN = re.compile(r"[\n\r]|[()]|[^\s()]+")


def parse_expression(text: str, begin: int = 0, stop: int | None = None) -> tuple[list[str], float | None]:
    """(names, freedom) of a licence expression: the licences that bind, in order, and how free they leave one.

    ``with`` binds tightest and adds an exception to the licence on its left, which eases it a little; ``and`` holds one
    to both sides and so to the stricter, ``or`` lets one take the freer side (of equals the left), and then the other side
    binds no more. A malformed expression has all names that were read and no freedom.
    """
    names: list[str] = []
    out: list[tuple[float, str | tuple]] = []  # names that bind, as a tree
    ops: list[str] = []
    rank = {"or": 1, "and": 2, "with": 3}
    operand = True  # what may come next

    def apply() -> bool:
        op = ops.pop()
        if len(out) < 2:
            return False
        (b, right), (a, left) = out.pop(), out.pop()
        if op == "or":
            out.append((b, right) if b > a else (a, left))
        elif op == "and":
            out.append((min(a, b), (left, right)))
        else:
            out.append((min(1.0, a + 0.1), left))
        return True

    good = True
    for found in TOKEN.finditer(text, begin, len(text) if stop is None else stop):
        token = found[0]
        if token in "\n\r":
            break
        low = token.lower()
        if low == "(":
            good &= operand
            ops.append("(")
        elif low == ")":
            good &= not operand
            while good and ops and ops[-1] != "(":
                good &= apply()
            good = good and bool(ops)
            if good:
                ops.pop()
        elif low in rank:
            good &= not operand
            while good and ops and ops[-1] != "(" and rank[ops[-1]] >= rank[low]:
                good &= apply()
            ops.append(low)
            operand = True
        else:
            if not re.fullmatch(r"[A-Za-z0-9.+:-]+", token):
                break  # a comment's end or prose: the expression stops here
            if not operand:
                break
            if not (ops and ops[-1] == "with"):
                names.append(low)
            out.append((freedom(low), low))
            operand = False
        if not good:
            return names, None
    while ops:
        if ops[-1] == "(" or not apply():
            return names, None
    if len(out) != 1 or operand:
        return names, None
    bind, left = [], [out[0][1]]
    while left:
        if isinstance(one := left.pop(), str):
            bind.append(one)
        else:
            left += reversed(one)
    return bind, out[0][0]


@lru_cache(4)
def _tags(tags: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in tags:
        a.add_word(t, len(t))
    a.make_automaton()
    return a


def expressions_in(text: bytes, tags: tuple[str, ...]) -> Iterator[tuple[list[str], float | None]]:
    """The expression behind each identifier tag, up to the next tag at most, so each character is read once."""
    own, ends = text.decode("utf-8", "replace"), []
    if any(t.encode() in (low := text.lower()) for t in tags):
        # lower case is that of ASCII letters alone, so both texts have the same places
        ends = [(end + 1, end + 1 - size) for end, size in _tags(tags).iter(low.decode("utf-8", "replace"))]
    for (begin, _), (_, stop) in pairwise([*ends, (0, len(own))]):
        yield parse_expression(own, begin, max(begin, stop))


def as_label(name: str) -> str:
    """A name read from an expression as a label: one that neither is nor continues a known identifier has a question mark."""
    return name if known(name) else f"?{name}"


@lru_cache(4)
def _automaton(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Keys are phrases between blanks, as byte characters; a key may be both a base phrase and a notice."""
    at: dict[str, list[tuple[int, str]]] = {}
    for kind, pairs in ((0, base), (1, notices)):
        for phrase, label in pairs:
            at.setdefault(f" {phrase} ".encode().decode("latin-1"), []).append((kind, label))
    a = ahocorasick.Automaton()
    for key, what in at.items():
        a.add_word(key, (len(key), tuple(what)))
    a.make_automaton()
    return a


def _scan(base, notices, tags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(base, notices)
        for b in slices(batches):
            rows = []
            for text in raw(b.column(1)):
                text = text or b""
                words = words_of(text)
                joined = b" ".join([b"", *words, b""])
                n, first, last, labels, more, bound = 0, None, None, set(), set(), set()
                for end, (size, what) in a.iter(joined.decode("latin-1")):
                    for kind, label in what:
                        if kind == 0:
                            at = end - size + 1
                            n += 1
                            labels.add(label)
                            first = at if first is None else min(first, at)
                            last = at if last is None else max(last, at)
                        else:
                            more.add(label)
                told = list(expressions_in(text, tags))
                for names, _ in told:
                    bound.update(map(as_label, names))
                free = min((value for _, value in told if value is not None), default=None)
                nth = lambda at: None if at is None else joined.count(b" ", 0, at)
                evidence = 1.0
                for weight, own in zip(WEIGHTS, (labels, more, bound), strict=True):
                    evidence *= (1 - weight) ** len(own)
                whole = sorted(labels | more | bound)
                if free is None and whole:
                    free = min(freedom(x.removeprefix("?")) for x in whole)
                rows.append((len(words), n, nth(first), nth(last), ",".join(sorted(labels)), ",".join(whole), (1 - evidence) * (free or 0.0), 1 - evidence, free))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 3
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "evidence", "freedom"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """A row for each row: word count, base phrases' places, labels (distinct, sorted, comma-joined), score, evidence and
    freedom.

    Labels are those of the phrases and the licences that bind by the tagged expressions; a name in an expression that is no
    known licence's is marked (``?name``). ``freedom`` is the strictest valid
    expression's, else that of the strictest label, else null; ``evidence`` grows with each independent sign (0: none);
    ``score`` is their product, 0 where nothing is found or nothing may be used. A null or empty text has no words and no
    labels; a null id stays null; repeated rows repeat; an empty table gives an empty one; other columns, whatever their
    names, are not looked at. No shuffle; a text is read whole, whatever its length, in time and memory in proportion to it.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_scan(tuple(base.items()), tuple(notices.items()), tuple(tags)), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, evidence double, freedom double")
