"""The few functions that Spark has no operator for, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import hmac as hmac_lib
import json
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, LongType, StringType, StructField, StructType

from sedge.functions import patterns as P


#: Texts of a batch that are Python's at a time.
_STEP = 256


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """A batch goes in and out as Arrow; few of its texts at a time are strings of Python's, which take up to four times as much."""
    one = lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)
    parts = [pa.array([one(t) for t in texts.slice(at, _STEP).to_pylist()], texts.type) for at in range(0, len(texts), _STEP)]
    return pa.concat_arrays(parts) if parts else texts


def nfkc(text: Column) -> Column:
    """NFKC. ASCII is NFKC already, so only rows with other characters carry their text to Python."""
    return F.coalesce(_nfkc(F.when(F.octet_length(text) > F.length(text), text)), text)


#: What :func:`may_mark` says of a line.
MAY_ANCHOR, MAY_INJECT = 1, 2


def _may_mark(texts: pa.Array) -> pa.Array:
    """Lists stay as Arrow's buffers: their lines are searched where they lie."""
    first, last = (texts.offsets[0].as_py(), texts.offsets[-1].as_py()) if len(texts) else (0, 0)
    lines = texts.values.slice(first, last - first)
    said = [pc.multiply(pc.match_substring_regex(lines, pattern).cast(pa.int8()), pa.scalar(bit, pa.int8())) for bit, pattern in ((MAY_ANCHOR, P.MAY_ANCHOR), (MAY_INJECT, P.MAY_INJECT))]
    at = pc.subtract(texts.offsets, pa.scalar(first, pa.int32())) if len(texts) else pa.array([0], pa.int32())
    return pa.ListArray.from_arrays(at, pc.add(*said), mask=texts.is_null() if texts.null_count else None)


def marked(rows: DataFrame, lines: str, to: str) -> DataFrame:
    """``rows`` with ``to``: for each line of an array, whether it may be an anchor or injection-shaped, as a sum of the
    numbers above. A line is without a bit only if it certainly is not; the patterns decide about the rest.

    Not a UDF: Catalyst writes out what a UDF reads into it as one nested expression, which a redaction chain outgrows.
    """

    def run(batches):
        for batch in batches:
            yield batch.append_column(to, _may_mark(batch.column(lines)))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(to, ArrayType(ByteType()))]))


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key repeats")
    return out


def _no_constant(name):
    raise ValueError(f"{name} is not a number")


def strict_load(text: str):
    """A JSON value; repeated keys, NaN and infinities are errors."""
    return json.loads(text, object_pairs_hook=_no_repeats, parse_constant=_no_constant)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null where a text is null or no JSON (of repeated keys the last counts)."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def spaced_json(texts: pd.Series) -> pd.Series:
    """The same with a blank after each comma and colon, as artifacts are written."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False))


@F.pandas_udf(StringType())
def strict_json(texts: pd.Series) -> pd.Series:
    """Canonical JSON of what passes :func:`strict_load`, else null."""

    def one(t):
        try:
            return None if t is None else canonical(strict_load(t))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


@F.pandas_udf(DoubleType())
def round4(values: pd.Series) -> pd.Series:
    """Four places, half to even on the binary value, which none of Spark's roundings does. For display only."""
    return values.map(lambda v: None if v is None or v != v else round(float(v), 4))


def hmac_hex(text: Column, key: bytes, size: int = 64) -> Column:
    """The first ``size`` hex digits of HMAC-SHA-256."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hmac_lib.new(key, t.encode(), hashlib.sha256).hexdigest()[:size])

    return run(text)


# Where a tool's answer keeps its text, in order of preference.
TEXT_KEYS = ("text", "content", "output", "result", "message", "tool_result")


def text_of(value) -> str:
    """The text inside a nested answer: strings as they are, lists joined by line breaks, objects by their first text key."""
    stack, out = [value], []
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            key = next((k for k in TEXT_KEYS if v.get(k)), None)
            if key is not None:
                stack.append(v[key])
    return "\n".join(x for x in out if x)


@F.pandas_udf(StringType())
def extract_text(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else text_of(json.loads(t))
        except ValueError:
            return t

    return texts.map(one)


ROW_SET = ArrayType(StructType([StructField("path", StringType()), StructField("columns", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType()))), StructField("n", LongType()), StructField("json", StringType())]))


def scalar_text(v) -> str | None:
    return None if v is None else "true" if v is True else "false" if v is False else str(v)


def find_row_sets(value) -> list[dict]:
    """Lists of at least one object with the same scalar fields in the same order, with the paths that lead to them."""
    out, stack = [], [("$", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, list):
            if v and all(isinstance(r, dict) and r and list(r) == list(v[0]) and not any(isinstance(x, (dict, list)) for x in r.values()) for r in v):
                out.append({"path": path, "columns": list(v[0]), "rows": [[scalar_text(x) for x in r.values()] for r in v], "n": len(v), "json": canonical(v)})
            stack += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, dict):
            stack += [(f"{path}.{k}", x) for k, x in reversed(list(v.items()))]
    return out


@F.pandas_udf(ROW_SET)
def row_sets(texts: pd.Series) -> pd.Series:
    """All uniform row sets of a JSON text, in document order; null for what is no JSON."""

    def one(t):
        try:
            return None if t is None else find_row_sets(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)
