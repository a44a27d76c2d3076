"""Chat and tool logs: which result answers which call, and with what trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tools and the trust that their output gets.
TIERS = {"Task": "subagent_return", "Agent": "subagent_return", "Bash": "untrusted_tool_output", "shell_command": "untrusted_tool_output", "exec_command": "untrusted_tool_output", "Read": "repo_source", "WebFetch": "untrusted_web", "WebSearch": "untrusted_web", "mcp:searxng": "untrusted_web", "mcp:linear": "semi_trusted_service", "mcp:github": "semi_trusted_service"}


def good_id(c):
    """A correlation id has 1 to 1024 bytes."""
    return F.octet_length(c).between(1, 1024)


def correlate_messages(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results joined to the name of their call, for logs in which a call comes before its result.

    ``calls``: request, pos, id, name; ``results``: request, pos, id, text. An id declared again with another name is void
    from there on; an id may be any text, the empty one too, and null ids and names take no part. One ordered pass over
    both kinds of rows, by (request, id): no join.
    """
    calls = calls.where("name is not null")
    both = calls.select("request", "pos", "id", "name", F.lit(None).cast("string").alias("text"), F.lit(0).alias("is_result")).unionByName(results.select("request", "pos", "id", F.lit(None).cast("string").alias("name"), "text", F.lit(1).alias("is_result")))
    before = Window.partitionBy("request", "id").orderBy("pos", "is_result").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.where("id is not null").withColumn("tool", F.min("name").over(before)).withColumn("_other", F.max("name").over(before))
    return seen.where("is_result = 1 and tool is not null and tool = _other").select("request", "pos", "id", "tool", "text")


def correlate_responses(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The same for logs in which a call may also follow: an id called more than once, by any name, is void."""
    once = calls.where(good_id("id") & F.col("name").isNotNull()).groupBy("request", "id").agg(F.count("*").alias("n"), F.min("name").alias("tool")).where("n = 1").drop("n")
    return results.where(good_id("id")).join(once, ["request", "id"]).select("request", "pos", "id", "tool", "text")


def with_tier(rows: DataFrame, tool: str = "tool", tiers: dict[str, str] = TIERS, default: str | None = None) -> DataFrame:
    """``trust_tier`` and ``tool_source``, the entry it is from: the tool's own name, else its server, ``mcp:server``, which
    names of the forms ``mcp__server__tool`` and ``mcp:server:tool`` have. Rows without a tier go unless a default is given.
    The table is a fixed, small one, so it is a map in the expression, not a join."""
    known = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    server = F.coalesce(*[F.nullif(F.regexp_extract(tool, p, 1), F.lit("")) for p in (r"(?s)\Amcp__((?:(?!__).)+)", r"(?s)\Amcp:([^:]*)")])
    keys = [F.col(tool), F.concat(F.lit("mcp:"), server)]
    found = F.coalesce(*[F.when(F.try_element_at(known, k).isNotNull(), k) for k in keys])
    out = rows.withColumn("tool_source", found).withColumn("trust_tier", F.coalesce(F.try_element_at(known, F.col("tool_source")), F.lit(default)))
    return out if default else out.where("trust_tier is not null")


def first_documents(rows: DataFrame, limit: int, request: str = "request", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The first ``limit`` documents of each request, with their ordinal."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(request).orderBy(*order))).where(F.col("ordinal") <= limit)


def truncated(rows: DataFrame, limit: int, request: str = "request") -> DataFrame:
    """(request, documents, truncated): how many documents a request has and how many its limit cuts off."""
    return rows.groupBy(request).agg(F.least(F.count("*"), F.lit(limit)).alias("documents"), F.greatest(F.count("*") - limit, F.lit(0)).alias("truncated"))


def outcome(withheld, cards, savings, minimum: float = 0.25):
    return F.when(withheld > 0, "withheld").when(cards == 0, "no_cards").when(F.coalesce(savings < minimum, F.lit(True)), "below_savings_gate").otherwise("eligible")


def answers(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Each user turn with the next assistant turn after it in its conversation, if one comes before another user turn."""
    after = Window.partitionBy(conv).orderBy("turn")
    rows = turns.where(F.col("role").isin("user", "assistant")).withColumn("_next", F.lead(F.struct("role", "turn", "text")).over(after))
    return rows.where("role = 'user' and _next.role = 'assistant'").select(conv, F.col("turn").alias("asked_at"), F.col("_next.turn").alias("answered_at"), F.col("text").alias("question"), F.col("_next.text").alias("answer"))


def bounded_counter(rows: DataFrame, name: str, order: list[str], limit: int = 32, other: str = "__other__") -> DataFrame:
    """Counts by name for the first ``limit`` names to appear, and one for all others.

    The order in which names appear is a sort of one row per name, of which only the first ``limit`` leave it.
    """
    n = rows.groupBy(name).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n"))
    kept = n.orderBy("_first", name).limit(limit).select(name, F.lit(True).alias("_kept"))
    bucket = F.when(F.col("_kept"), F.col(name).cast("string")).otherwise(other)
    return n.join(F.broadcast(kept), name, "left").groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
