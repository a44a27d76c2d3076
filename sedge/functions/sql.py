"""The text functions for queries that are written as SQL: scalar ones as functions of a session, redaction as a view."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sedge.functions import patterns as P
from sedge.functions.udfs import _nfkc


def _r(pattern: str) -> str:
    return "r'" + pattern + "'"


SPACES = ", ".join(str(ord(c)) for c in P.SPACES)
EDGES = f"[{P.SPACE_SET}]+"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Name: (parameters, type, expression)."""
    strip = lambda x: f"regexp_replace(regexp_replace({x}, {_r('^' + EDGES)}, ''), {_r(EDGES + chr(92) + 'z')}, '')"
    bare = strip(f"regexp_replace({strip('line')}, {_r('^[-*#>' + P.SPACE_SET + '0-9.]+')}, '')")
    short = f"concat(regexp_replace(substring({bare}, 1, size - 1), {_r(EDGES + chr(92) + 'z')}, ''), '...')"
    schemes = "t"
    for pattern, to in ((r"!\[\]\([^)]+\)", "[defanged-image: unnamed]"), (r"!\[([^\]]+)\]\([^)]+\)", "[defanged-image: $1]"), (r"(?<!!)\[([^\]]*)\]\([^)]+\)", "$1 [defanged-link]"), *((rf"(?iu){P.EDGE}{x}:", f"{x}-defanged:") for x in ("javascript", "vbscript", "data"))):
        schemes = f"regexp_replace({schemes}, {_r(pattern)}, '{to}')"
    return {
        "rough_tokens": ("t STRING", "BIGINT", f"CAST(coalesce(regexp_count(t, {_r(P.TOKEN)}), 0) AS BIGINT)"),
        "text_digest": ("t STRING", "STRING", "sha2(encode(t, 'UTF-8'), 256)"),
        "strip_text": ("t STRING", "STRING", strip("t")),
        "is_critical": ("t STRING", "BOOLEAN", f"t RLIKE {_r(P.CRITICAL)}"),
        "is_open_question": ("t STRING", "BOOLEAN", f"t RLIKE {_r(P.QUESTION)}"),
        "has_url": ("t STRING", "BOOLEAN", f"t RLIKE {_r(P.URL)}"),
        "looks_injected": ("t STRING", "BOOLEAN", f"t RLIKE {_r(P.INJECTION)}"),
        "clean_claim": ("line STRING, size INT", "STRING", f"CASE WHEN length({bare}) > size THEN {short} ELSE {bare} END"),
        "defang_claim": ("t STRING", "STRING", f"replace(replace({schemes}, 'https://', 'hxxps://'), 'http://', 'hxxp://')"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary ones of the session; the names that there are now. Catalyst inlines them, so they
    cost what the same Columns cost."""
    for name, (parameters, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(bodies())


def _q(text: str) -> str:
    """A string literal of any characters."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mask(secret: P.Secret) -> str:
    pattern = _q(secret.pattern)
    if not secret.spans_lines:
        return f"regexp_replace(redacted, {pattern}, {_q(chr(92) + P.MASK.replace(']', chr(92) + ']'))})"
    breaks = f"regexp_replace(hit, {_q('[^' + P.LINE_BREAK[1:])}, '')"
    between = f"split(redacted, {pattern}, -1)"
    rest = f"zip_with(slice({between}, 2, size({between})), regexp_extract_all(redacted, {pattern}, 0), (gap, hit) -> concat({_q(P.MASK)}, {breaks}, coalesce(gap, '')))"
    return f"concat(element_at({between}, 1), array_join({rest}, ''))"


def redaction(source: str, text: str = "text") -> str:
    """A query in SQL that adds ``redacted`` and ``findings`` to a table or view, as :func:`sedge.functions.text.redact` does:
    a step a pipe, each of which sees what the one before has left. It calls ``nfkc_text``, which :func:`register_redaction`
    makes. ``source`` and ``text`` are names; a source must not have columns of the names that are added."""
    odd = "octet_length(redacted) > length(redacted)"
    steps = [
        f"FROM {source}", f"EXTEND CASE WHEN contains({text}, '\\r') THEN regexp_replace({text}, {_q(chr(13) + chr(10) + '?')}, '\\n') ELSE {text} END AS redacted",
        f"SET redacted = coalesce(nfkc_text(CASE WHEN {odd} THEN redacted END), redacted)",  # a call inside a CASE is made for every row
        f"SET redacted = CASE WHEN {odd} THEN translate(regexp_replace(redacted, {_q(P.ZERO_WIDTH + '|' + P.BIDI + '|' + P.TAG)}, ''), {_q(P.CONFUSABLE)}, {_q(P.CONFUSED_WITH)}) ELSE redacted END",
        f"SET redacted = regexp_replace(redacted, {_q(P.CONTROL)}, '')",
    ]
    for k, secret in enumerate(P.SECRETS):
        may = " OR ".join(f"contains(redacted, {_q(x)})" for x in secret.literals) or f"redacted RLIKE {_q(secret.guard)}"
        steps += [f"EXTEND ({may}) AND redacted RLIKE {_q(secret.pattern)} AS _hit{k}", f"SET redacted = CASE WHEN _hit{k} THEN {_mask(secret)} ELSE redacted END"]
    named = ", ".join(f"CASE WHEN _hit{k} THEN {_q(secret.name)} END" for k, secret in enumerate(P.SECRETS))
    return "\n|> ".join([*steps, f"EXTEND array_compact(array({named})) AS findings", "DROP " + ", ".join(f"_hit{k}" for k in range(len(P.SECRETS)))])


def register_redaction(spark: SparkSession, source: str, view: str, text: str = "text") -> None:
    """A temporary view ``view`` of ``source`` with ``redacted`` and ``findings``, for statements that only speak SQL. It is
    worked out where it is read, columns that are not asked for are not, and filters on the source's columns reach its scan."""
    spark.udf.register("nfkc_text", _nfkc)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS {redaction(source, text)}")
