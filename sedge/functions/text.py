"""Scalar text functions over Columns, and the redaction chain over DataFrames."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import patterns as P
from sedge.functions.udfs import MAY_ANCHOR, MAY_INJECT, nfkc


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.trim(_col(c), F.lit(P.SPACES))


def normalize(df: DataFrame, text: str = "text", to: str = "normal") -> DataFrame:
    """Line breaks to LF, NFKC, hidden characters out, lookalike letters folded, control characters out."""
    own = F.col(to)
    df = df.withColumn(to, F.when(F.contains(F.col(text), F.lit("\r")), F.regexp_replace(F.col(text), "\r\n?", "\n")).otherwise(F.col(text))).withColumn(to, nfkc(own))
    more = F.octet_length(own) > F.length(own)  # ASCII holds neither
    df = df.withColumn(to, F.when(more, F.regexp_replace(own, P.HIDDEN, "")).otherwise(own))
    df = df.withColumn(to, F.when(more & own.rlike(P.CONFUSABLE_BLOCKS), F.translate(own, P.CONFUSABLE, P.CONFUSED_WITH)).otherwise(own))
    return df.withColumn(to, F.regexp_replace(own, P.CONTROL, ""))


def _masked(now: Column, secret: P.Secret) -> Column:
    if not secret.spans_lines:
        return F.regexp_replace(now, secret.pattern, "\\" + P.MASK.replace("]", "\\]"))
    between = F.split(now, secret.pattern, -1)
    hits = F.regexp_extract_all(now, F.lit(secret.pattern), F.lit(0))
    breaks = lambda x: F.regexp_replace(x, "[^" + P.LINE_BREAK[1:], "")
    rest = F.zip_with(F.slice(between, 2, F.size(between)), hits, lambda gap, hit: F.concat(F.lit(P.MASK), breaks(hit), F.coalesce(gap, F.lit(""))))
    return F.concat(F.element_at(between, 1), F.array_join(rest, ""))


def redact(df: DataFrame, text: str = "text", to: str = "redacted", findings: str = "findings", upto: int = len(P.SECRETS)) -> DataFrame:
    """``df`` with the normalised, masked text and the names of the patterns that matched, in order.

    A mask keeps its match's line breaks, so line numbers hold. Each pattern sees what the one before has left; each is
    a projection of its own, as one nested expression would grow fourfold at each step. Null text: null, no findings.
    """
    df = normalize(df, text, to)
    now = F.col(to)
    for k, s in enumerate(P.SECRETS[:upto]):
        may = functools.reduce(lambda a, b: a | b, [F.contains(now, F.lit(x)) for x in s.literals] or [now.rlike(s.guard)])
        df = df.withColumn(f"_hit{k}", may & now.rlike(s.pattern))
        df = df.withColumn(to, F.when(F.col(f"_hit{k}"), _masked(now, s)).otherwise(now))
    names = F.array_compact(F.array(*[F.when(F.col(f"_hit{k}"), F.lit(s.name)) for k, s in enumerate(P.SECRETS[:upto])]))
    return df.withColumn(findings, names).drop(*[f"_hit{k}" for k in range(upto)])


def lines(text: Column | str) -> Column:
    """The lines of a normalised text; a break at the very end begins no further line."""
    c = _col(text)
    own = F.when(F.octet_length(c) > F.length(c), F.split(c, P.LINE_BREAK, -1)).otherwise(F.split(c, "\n", -1))
    return F.when(F.element_at(own, -1) == "", F.slice(own, 1, F.size(own) - 1)).otherwise(own)


def is_critical(c: Column) -> Column:
    return c.rlike(P.CRITICAL)


def is_question(c: Column) -> Column:
    return c.rlike(P.QUESTION)


def is_anchor(c: Column) -> Column:
    return c.rlike(P.ANCHOR)


def may_anchor(marks: Column) -> Column:
    """Of a line's number in ``udfs.marked``: only then it is worth while to search the line for anchors."""
    return marks.bitwiseAND(F.lit(MAY_ANCHOR).cast("tinyint")) != 0


def may_inject(marks: Column) -> Column:
    return marks.bitwiseAND(F.lit(MAY_INJECT).cast("tinyint")) != 0


def has_url(c: Column) -> Column:
    return F.contains(c, F.lit("://")) & c.rlike(P.URL)


def clean_claim(line: Column, limit: Column | int = 220) -> Column:
    """The line without list, heading, quote and number marks in front, cut to ``limit`` characters with dots."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    own = strip(F.regexp_replace(strip(line), f"^[-*#>{P.SPACE_SET}0-9.]+", ""))
    short = F.concat(F.rtrim(F.substring(own, 1, limit - 1), F.lit(P.SPACES)), F.lit("..."))
    return F.when(F.length(own) > limit, short).otherwise(own)


def card_claim(line: Column) -> Column:
    return clean_claim(line, F.when(is_anchor(strip(line)), 4096).otherwise(220))


def defang_claim(c: Column) -> Column:
    """Images, links, dangerous schemes and web addresses, made harmless; code stays as it is."""
    own = F.regexp_replace(c, r"!\[\]\([^)]+\)", "[defanged-image: unnamed]")
    own = F.regexp_replace(own, r"!\[([^\]]+)\]\([^)]+\)", r"[defanged-image: $1]")
    own = F.regexp_replace(own, r"\[(?<!!\[)([^\]]*)\]\([^)]+\)", r"$1 [defanged-link]")
    own = F.when(F.contains(c, F.lit("](")), own).otherwise(c)
    safe = own
    for scheme in ("javascript", "vbscript", "data"):
        safe = F.regexp_replace(safe, rf"(?={P.first(scheme)}){P.START}(?iu:{scheme}):", f"{scheme}-defanged:")
    safe = F.replace(F.replace(safe, F.lit("https://"), F.lit("hxxps://")), F.lit("http://"), F.lit("hxxp://"))
    return F.when(F.contains(c, F.lit(":")), safe).otherwise(own)  # most claims have neither, which is far cheaper to see


def defang(c: Column) -> Column:
    return F.translate(defang_claim(c), "`", "'")


def claim_span(c: Column) -> Column:
    """The defanged claim between fences one backtick longer than any run in it."""
    safe = defang_claim(c)
    longest = F.array_max(F.transform(F.regexp_extract_all(safe, F.lit("(`+)"), F.lit(1)), F.length))
    longest = F.coalesce(F.when(F.contains(c, F.lit("`")), longest), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    return F.concat(fence, F.lit(" "), safe, F.lit(" "), fence)


def token_count(c: Column | str) -> Column:
    """Runs of ASCII word characters, and every other character that is no white space, count one each."""
    # what is left without white space and all but the first of a run's characters; regexp_count would make each token a string
    return F.coalesce(F.length(F.regexp_replace(_col(c), P.NO_TOKEN, "")), F.lit(0)).cast("long")


def digest(c: Column | str) -> Column:
    return F.sha2(F.encode(_col(c), "UTF-8"), 256)


def flags(evidence: Column, findings: Column, may: Column | None = None) -> Column:
    """``may``: false where the evidence is known not to be injection-shaped."""
    injection = evidence.rlike(P.INJECTION) if may is None else may & evidence.rlike(P.INJECTION)
    return F.array_compact(F.array(F.when(F.size(findings) > 0, F.lit("redacted")), F.when(injection, F.lit("injection-shaped")), F.when(has_url(evidence), F.lit("has-url"))))


def toon_field(value: Column, kind: str = "string", delimiter: str = "\t") -> Column:
    """A scalar as a field of a row encoding: null and booleans bare, other text quoted where it could be misread."""
    if kind == "boolean":
        return F.coalesce(value.cast("string"), F.lit("null"))
    text = value.cast("string")
    odd = (text == "") | (strip(text) != text) | text.rlike(r'[\n\r\t\\"\[\]{}:]') | text.contains(delimiter) | F.lower(text).isin("true", "false", "null")
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(mark))
    return F.when(text.isNull(), F.lit("null")).when(odd, F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(text)


def entry_key(raw_sha: Column, settings_json: Column) -> Column:
    return F.concat(raw_sha, F.lit("-"), F.substring(digest(settings_json), 1, 16))


def savings(base: Column, candidate: Column) -> Column:
    """(base - candidate) / base, null for an empty base; not rounded, as gates compare it as it is."""
    return F.when(base > 0, (base - candidate) / base)


def row_set_name(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(path, r"[^\p{L}\p{N}_]+", "_"), "^_+|_+\\z", ""), F.lit("")), F.lit("rows"))


def slug(c: Column) -> Column:
    """NFKC, ASCII lower case, other characters to single hyphens; null if nothing or a non-ASCII letter is left."""
    low = F.translate(nfkc(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+\\z", "")
    return F.when(~low.rlike(r"[\p{L}&&[^\x00-\x7F]]") & (own != ""), own)


def custody_label(c: Column) -> Column:
    return F.translate(F.translate(F.regexp_replace(F.regexp_replace(c, r"^[\t-\r ]+", ""), r"[\t-\r ]+\z", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "_", "-")


def joined_key(*cols: Column, size: int = 64) -> Column:
    """SHA-256 of the fields, a line each."""
    return F.substring(digest(F.concat_ws("\n", *cols)), 1, size)
