"""Row sets inside JSON, and what writing them as row encodings saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.spread import cut
from sedge.functions.udfs import canonical_json, row_sets
from sedge.operators import render


def toon_of(name: Column, columns: Column, rows: Column, delimiter: str = "\t") -> Column:
    """A whole row encoding from arrays of stringified fields (null for null)."""
    line = lambda r: F.concat(F.lit("  "), F.array_join(F.transform(r, lambda v: T.toon_field(v, delimiter=delimiter)), delimiter))
    mark = {",": "", "\t": ' delimiter="\\t"'}.get(delimiter, f' delimiter="{delimiter}"')
    head = F.concat(name, F.lit("["), F.size(rows).cast("string"), F.lit("]{"), F.array_join(columns, ","), F.lit("}" + mark + ":\n"))
    return F.concat(head, F.array_join(F.transform(rows, line), "\n"), F.lit("\n"))


def analyze(texts: DataFrame, key: str = "source", text: str = "value", minimum: float = 0.25) -> DataFrame:
    """A row for each uniform row set of each JSON text: path, name, rows, tokens as compact JSON and as a row encoding,
    the saving, and the format to use. A text without one, or that is no JSON, has a single row with compact JSON."""
    own = texts.select(key, F.col(text).alias("_t"), row_sets(text).alias("_s")).select(key, "_t", F.posexplode_outer("_s").alias("_n", "_x"))
    name = T.row_set_name(F.col("_x.path"))
    sized = own.select(key, "_t", "_x", name.alias("name"), T.token_count(F.coalesce(F.col("_x.json"), canonical_json("_t"))).alias("json_tokens"))
    sized = sized.withColumn("toon", F.when(F.col("_x").isNotNull(), toon_of(F.col("name"), F.col("_x.columns"), F.col("_x.rows"))))
    sized = sized.withColumn("toon_tokens", F.when(F.col("toon").isNotNull(), T.token_count("toon")))
    sized = sized.withColumn("savings", T.savings(F.col("json_tokens"), F.col("toon_tokens")))
    return sized.select(key, F.col("_x.path").alias("path"), F.when(F.col("_x").isNotNull(), F.col("name")).alias("name"), F.coalesce(F.col("_x.n"), F.lit(0)).alias("rows"), "json_tokens", "toon_tokens", "savings", F.when(F.col("savings") >= minimum, "toon").otherwise("compact-json").alias("recommended"), "toon")


#: Columns of a card's compact view: neither digest nor evidence, and a defanged claim.
VIEW = ["card_id", "source", "trust_tier", "line_start", "line_end", "claim", "confidence", "flags"]


def choose_card_format(cards: DataFrame, run: str = "run_id", wanted: str = "auto", minimum: float = 0.25) -> DataFrame:
    """(run, primary_tokens, toon, toon_tokens, savings, selected): JSON lines are always written; the row encoding is too
    if asked for, or in ``auto`` if it saves enough. Cards are read twice, so they are worked out once, into a checkpoint."""
    cards = cut(cards)
    view = cards.withColumn("claim", T.defang(F.col("claim"))).withColumn("flags", F.array_join("flags", ","))
    body = render.toon_rows(view.select(run, *VIEW), ["source", "card_id"], run, columns=VIEW)
    toon = body.select(run, render.toon_text(F.lit("cards"), F.col("n"), VIEW, F.col("body")).alias("toon"))
    line = canonical_json(F.to_json(F.struct("card_id", "source", "trust_tier", "sha256", "line_start", "line_end", "claim", "evidence", "confidence", "flags")))
    primary = cards.groupBy(run).agg(F.sum(T.token_count(line)).alias("primary_tokens"))
    own = primary.join(toon, run).withColumn("toon_tokens", T.token_count("toon")).withColumn("savings", T.savings(F.col("primary_tokens"), F.col("toon_tokens")))
    chosen = {"toon": F.lit(True), "jsonl": F.lit(False)}.get(wanted, F.coalesce(F.col("savings") >= minimum, F.lit(False)))
    return own.withColumn("selected", chosen)
