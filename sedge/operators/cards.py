"""Source cards: the lines of a document that matter, ranked, with where they stand.

Lines stay in one array per document until candidates are known; only candidates, with their evidence, are exploded
and shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.udfs import marked


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "redacted") -> DataFrame:
    """(key, line_number from 1, line): a row for each line of a normalised text."""
    rows = docs.select(key, F.posexplode_outer(T.lines(text)).alias("_at", "line")).where("line is not null")  # see cards()
    return rows.select(key, (F.col("_at") + 1).alias("line_number"), "line")


def classified(lines: DataFrame) -> DataFrame:
    """``line_rows`` with the classes of each line."""
    bare = T.strip("line")
    return lines.withColumns({
        "is_blank": bare == "",
        "is_critical": T.is_critical(bare),
        "is_question": T.is_question(bare),
        "has_url": T.has_url(bare),
        "is_bullet": bare.rlike(r"^[-*#]"),
    })


def cards(docs: DataFrame, max_cards: int = 24, key: str = "doc_id", text: str = "redacted", findings: str = "findings") -> DataFrame:
    """At most ``max_cards`` cards for each document of a redacted table.

    Anchors (constraints and open questions) come first, then URL and bullet lines, each in line order; with neither,
    the first ``max_cards`` lines with anything on them. Claims that come out empty are passed over, and so is a repeated
    claim unless it is an anchor's. A document without lines has no cards.
    """
    return ranked(candidates(docs, max_cards, text), max_cards, key, findings)


def candidates(docs: DataFrame, max_cards: int = 24, text: str = "redacted") -> DataFrame:
    """``docs`` with the number of their lines (``_n``) and their candidates for cards (``_found``) in place of their text."""
    rest = [c for c in docs.columns if c != text]
    own = marked(docs.withColumn("_lines", T.lines(text)).drop(text), "_lines", "_may").withColumn("_bare", F.transform("_lines", T.strip))

    def class_of(bare, may):
        found = F.when(T.may_anchor(may) & T.is_anchor(bare), 1).when(T.has_url(bare) | bare.rlike(r"^[-*#]"), 2).otherwise(3)
        return F.when(bare == "", 4).otherwise(found)

    def candidate(x):
        """Class, index, line and the lines around; taken out of the array before it is exploded, so that no row of the
        explosion carries the whole document along."""
        i = x.i
        around = lambda c: F.slice(c, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))
        return F.struct(x.c.alias("c"), i.alias("i"), F.element_at("_lines", i + 1).alias("line"), around("_lines").alias("around"), F.exists(around("_may"), T.may_inject).alias("may"))

    own = own.withColumn("_class", F.transform("_bare", lambda x, i: F.struct(class_of(x, F.get("_may", i)).alias("c"), i.alias("i"))))
    own = own.withColumn("_marked", F.filter("_class", lambda x: x.c <= 2))
    plain = F.slice(F.filter("_class", lambda x: x.c == 3), 1, max_cards)
    own = own.withColumn("_at", F.when(F.size("_marked") > 0, F.col("_marked")).otherwise(plain))
    return own.select(*rest, F.size("_lines").alias("_n"), F.transform("_at", candidate).alias("_found"))


def ranked(found: DataFrame, max_cards: int = 24, key: str = "doc_id", findings: str = "findings") -> DataFrame:
    """The cards of what :func:`candidates` gives."""
    rest = [c for c in found.columns if c not in ("_n", "_found")]
    # explode_outer: from a plain explode Catalyst infers a filter on the array's size and pushes it below all the
    # projections of the redaction chain, writing the chain out fourfold at each of its steps
    rows = found.select(*rest, "_n", F.explode_outer("_found").alias("_x")).where("_x is not null")
    rows = rows.select(*rest, "_n", F.col("_x.c").alias("_class"), F.col("_x.i").alias("_i"), F.col("_x.line").alias("_line"), F.col("_x.around").alias("_around"), F.col("_x.may").alias("_injects"))
    rows = rows.select(
        *rest, "_class", "_i", "_injects",
        F.greatest(F.col("_i"), F.lit(1)).alias("line_start"), F.least(F.col("_i") + 2, F.col("_n")).alias("line_end"),
        T.clean_claim(F.col("_line"), F.when(F.col("_class") == 1, 4096).otherwise(220)).alias("claim"),
        T.strip(F.array_join("_around", "\n")).alias("evidence"),
    ).where("claim <> ''").repartition(key)
    again = F.row_number().over(Window.partitionBy(key, "claim", "_class").orderBy("_i"))
    once = rows.withColumn("_again", F.when(F.col("_class") > 1, again).otherwise(1)).where("_again = 1")
    ranked = once.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_class", "_i"))).where(F.col("_rank") <= max_cards)
    return ranked.select(
        *rest,
        F.format_string("src-%03d", "_rank").alias("card_id"), F.col("_rank").alias("card_rank"), "line_start", "line_end", "claim", "evidence",
        F.when((F.col("_class") == 1) | T.has_url(F.col("claim")), "medium").otherwise("low").alias("confidence"),
        T.flags(F.col("evidence"), F.col(findings), F.col("_injects")).alias("flags"),
    )


def withhold(docs: DataFrame, content: str = "content", max_bytes: int = 2_000_000) -> DataFrame:
    """``docs`` with ``withheld``, ``reason`` and ``text``: content over the cap or not UTF-8 keeps its digest alone."""
    over = F.octet_length(content) > max_bytes
    bad = ~F.is_valid_utf8(F.col(content).cast("string"))
    reason = F.when(over, "input-cap").when(bad, "redaction-error")
    return docs.withColumn("sha256", F.sha2(content, 256)).withColumn("reason", reason).withColumn("withheld", F.col("reason").isNotNull()).withColumn("text", F.when(F.col("reason").isNull(), F.col(content).cast("string")))


def with_tier(docs: DataFrame, overrides: DataFrame, default: str, path: str = "source") -> DataFrame:
    """``trust_tier`` by exact path, else by the nearest directory override above it, else ``default``; of overrides of one
    path the last given counts. ``overrides``: (position, path, trust_tier), of any length: the paths above each distinct
    path meet them by an equi join."""
    parts = F.split("_p", "/")
    above = docs.select(F.col(path).alias("_p")).distinct().select("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))).alias("_a"))
    last = overrides.groupBy(F.col("path").alias("_at")).agg(F.max_by("trust_tier", "position").alias("_t"))
    best = above.join(last, F.col("_a.at") == F.col("_at")).groupBy("_p").agg(F.max_by("_t", "_a.depth").alias("_tier"))
    own = docs.join(best, F.col(path) == F.col("_p"), "left").withColumn("trust_tier", F.coalesce("_tier", F.lit(default)))
    return own.drop("_p", "_tier")
