"""Fill-in-the-middle rows: a text is cut between units at two pseudo-random places and its three parts are reordered.

A unit grammar is given by its *boundaries*: pairs of neighbouring character classes between which one unit ends and the
next begins. The pairs become one zero-width pattern (a look behind and a look ahead each), at whose matches Spark's
``split`` cuts, so that the pieces together are the text. All of it is one projection of built-in functions: no shuffle,
no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import fresh, without

SPACE, OTHER, ANY = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[\s\S]"
#: Boundaries by the name of the unit: (class before, class after).
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "token": [(OTHER, SPACE)],  # white space, then what is none; white space at the end is a unit
    "word": [(OTHER, SPACE), (SPACE, OTHER)],  # runs of either
    "line": [(r"\n", ANY)],  # each with the newline that ends it
    "character": [(ANY, ANY)],
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width pattern that matches between two units."""
    return "|".join(f"(?<={before})(?={after})" for before, after in grammar)


def units(text: Column, grammar: str = "token") -> Column:
    """The units of a text, in order; they join up to it. An empty text, which splits into one empty piece, has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[grammar]), -1))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` (8 at most) unsigned 32-bit numbers drawn from the SHA-256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of. Parts hold no mark, so the marks found are those put in."""
    part = F.split(output, MARKS, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def transform(docs: DataFrame, grammar: str = "token", rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``restored`` added.

    ``rate`` percent of the texts are transformed, ``spm`` percent of those in the order suffix, prefix, middle, the others
    in the order prefix, suffix, middle. Texts that are empty or hold a mark stay ``plain``; a null text counts as an empty
    one and comes out empty. Draws depend on the seed and the id alone: rows that repeat an id are cut at the same draws,
    each within its own text, and rows of a null id share the draws of an empty id. Texts are cut whole, whatever their
    length, between code points. Rows repeat as they came; an empty table gives an empty one; input columns named like an
    added one give way to it.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")
    own = without(docs, *added)
    t, u, a, b, h, pre, mid, suf = (fresh(x, docs) for x in ("_t", "_u", "_a", "_b", "_h", "_pre", "_mid", "_suf"))
    text, c = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col
    cut = own.withColumn(t, text).withColumn(u, units(c(t), grammar)).withColumn(h, F.array(*draws(c(f"`{id_col}`"), seed))).withColumn("n", F.size(u).cast("long"))
    one, two = c(h)[0] % (c("n") + 1), c(h)[1] % (c("n") + 1)
    plain = (c(t) == "") | c(t).rlike(MARKS) | (c(h)[2] % 100 >= rate)
    form = F.when(plain, "plain").when(c(h)[3] % 100 < spm, "spm").otherwise("psm")
    joined = lambda start, length: F.when(c("form") != "plain", F.array_join(F.slice(u, start, length), ""))
    cut = cut.withColumns({a: F.least(one, two).cast("int"), b: F.greatest(one, two).cast("int"), "form": form})
    cut = cut.withColumns({pre: joined(F.lit(1), c(a)), mid: joined(c(a) + 1, c(b) - c(a)), suf: joined(c(b) + 1, F.size(u) - c(b))})
    output = (
        F.when(c("form") == "psm", F.concat(F.lit(PREFIX), pre, F.lit(SUFFIX), suf, F.lit(MIDDLE), mid))
        .when(c("form") == "spm", F.concat(F.lit(SUFFIX), suf, F.lit(PREFIX), pre, F.lit(MIDDLE), mid))
        .otherwise(c(t))
    )
    out = cut.withColumns({"prefix_chars": F.length(pre).cast("long"), "middle_chars": F.length(mid).cast("long"), "output": output})
    return out.withColumn("restored", restored(c("output"), c("form"))).select(*own.columns, *added)


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
x AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
