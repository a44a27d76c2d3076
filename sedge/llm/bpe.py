"""Byte-level BPE with a sentencepiece model that is written straight from a rank file.

Each token's bytes become printable characters, one a byte; such a piece's score is its negative rank, so the best
scored merge is the lowest ranked one. The model's normaliser is the identity, and no blank is added or escaped.
Texts are split by the rank file's pattern and each pre-token is encoded by itself; ids are the ranks.
"""

from __future__ import annotations

import base64
import hashlib
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from importlib.util import find_spec
from itertools import batched
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from sedge.llm.common import slices, without

#: Bytes, roughly, of the pre-tokens that a worker keeps with their ids; beyond, the table starts anew.
KEPT = 24 << 20
#: What an entry of that table takes besides its text and its ids, the longest pre-token kept, and how many are looked up
#: at a time.
ENTRY, LONGEST, STEP = 220, 64, 1 << 15
#: Characters from which on a text's pre-tokens are not all held at once.
LONG = 1 << 20


def byte_letters() -> list[str]:
    """A printable character for each byte: its own where it has one, else the next from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model. Ranks must be 0..n-1; the unknown piece has the id n."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=1)
    model.pieces.add(piece="<unk>", score=0.0, type=2)
    spec, norm = model.trainer_spec, model.normalizer_spec
    spec.model_type, spec.vocab_size, spec.unk_id = 2, len(ranks) + 1, len(ranks)
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    spec.treat_whitespace_as_suffix = spec.byte_fallback = False
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.letters = dict(enumerate(byte_letters()))
        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, packed; a pre-token that is a token is that token."""
        data = [w.encode() for w in words]
        whole = [self.ranks.get(d) for d in data]
        left = [i for i, r in enumerate(whole) if r is None]
        got = self.model.encode([data[i].decode("latin-1").translate(self.letters) for i in left], num_threads=1) if left else []
        new = {w: pack("<I", r) for w, r in zip(words, whole, strict=True) if r is not None}
        return new | {words[i]: np.array(ids, "<u4").tobytes() for i, ids in zip(left, got, strict=True)}

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        words = self.pattern.findall(text) if len(text) < LONG else (m[0] for m in self.pattern.finditer(text))
        for some in batched(words, STEP):
            if self.held > KEPT:
                self.known, self.held = {}, 0
            own = self.known
            if new := [w for w in dict.fromkeys(some) if w not in own]:
                got = self.learn(new)
                kept = {w: ids for w, ids in got.items() if len(w) <= LONGEST}
                self.known.update(kept)
                self.held += sum(len(w) + len(ids) + ENTRY for w, ids in kept.items())
                own = self.known if len(kept) == len(got) else ChainMap(got, self.known)
            out.append(b"".join(map(own.__getitem__, some)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(1)
def codec(name: str, pattern: str) -> Codec:
    """A worker's codec. ``name``: a file of the installed vocabulary package, or one sent by ``addFile``."""
    if find_spec("public_tokenizers"):
        import public_tokenizers

        if Path(at := public_tokenizers.path(name)).exists():
            return Codec(read_ranks(Path(at).read_bytes()), pattern)
    return Codec(read_ranks(Path(SparkFiles.get(name)).read_bytes()), pattern)


def _run(text_at: int, name: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for b in slices(batches, 256):
            n, ids_sha, text_sha, ids_out = [], [], [], []
            for text in b.column(text_at).to_pylist():
                packed = c.encode(text or "")
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
                if keep_ids:
                    ids_out.append(packed)
            cols = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = np.cumsum([0, *n], dtype="i4")
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids_out), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return run


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` added.

    A null text encodes as an empty one: no ids. Texts of any length are encoded whole, pre-token by pre-token; rows
    repeat as they came. Input columns named like an added column give way to it. No shuffle is made.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    own = without(docs, "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    at = [c.lower() for c in own.columns].index(text_col.lower())
    return own.mapInArrow(_run(at, vocabulary, pattern, keep_ids), f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def _decoded(at: int, name: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for b in slices(batches, 256):
            texts = [None if ids is None else c.decode(ids).decode("utf-8", "replace") for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``rows`` with the text of their ids as ``decoded``; null ids give null. An id outside the vocabulary is an error."""
    own = without(rows, "decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(_decoded(own.columns.index(ids_col), vocabulary, ""), f"{kinds}, decoded string")
