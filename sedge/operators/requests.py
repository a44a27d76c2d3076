"""Request bodies of two chat protocols taken apart: which tool results they carry, and with what trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import chatlog

#: Blocks of a message that keep their order; positions are message * BLOCKS + block.
BLOCKS = 1 << 32


def _text(block: str, name: str) -> Column:
    """A field of a JSON object if it is a string, else null."""
    value = F.expr(f"try_variant_get(try_parse_json({block}), '$.{name}', 'variant')")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(block, f"$.{name}"))


def _texts(content: Column, kind: str) -> Column:
    """The texts of a content: itself if it is a string, else those of its parts of one kind, in order."""
    parts = F.from_json(F.when(content.startswith("["), content), "array<struct<type:string,text:string>>")
    own = F.transform(F.filter(parts, lambda p: (p.type == kind) & p.text.isNotNull()), lambda p: p.text)
    return F.coalesce(own, F.array().cast("array<string>"))


def _blocks(requests: DataFrame, body: str) -> DataFrame:
    """(request, pos, role, block): every block of a Messages body, as JSON."""
    m = requests.select("request", F.posexplode(F.from_json(body, "struct<messages:array<string>>").messages).alias("_m", "_x"))
    b = m.select("request", "_m", _text("_x", "role").alias("role"), F.from_json(F.get_json_object("_x", "$.content"), "array<string>").alias("_c"))
    return b.select("request", "_m", "role", F.posexplode("_c").alias("_b", "block")).select("request", (F.col("_m") * F.lit(BLOCKS) + F.col("_b")).alias("pos"), "role", "block")


def _documents(found: DataFrame, provider: str, limit: int, across: bool) -> DataFrame:
    """Results (request, pos, id, tool, texts) as documents, the first ``limit`` of each request. A text is numbered within
    its result, or, with ``across``, within its request."""
    tiered = chatlog.with_tier(found.where("size(texts) > 0"))
    texts = tiered.select("request", "pos", "tool_source", "trust_tier", F.substring(T.digest("id"), 1, 16).alias("link"), F.posexplode("texts").alias("n", "body"))
    first = chatlog.first_documents(texts, limit, "request", ("pos", "n"))
    n = (F.col("ordinal") - 1) if across else F.col("n")
    source = F.concat_ws(":", F.lit(provider), "tool_source", "link", n.cast("string"))
    return first.select("request", "ordinal", source.alias("source"), "trust_tier", "body")


def messages_documents(requests: DataFrame, body: str = "body", limit: int = 64, provider: str = "anthropic") -> DataFrame:
    """(request, ordinal, source, trust_tier, body): texts of tool results whose call came before, by one name only, and
    whose tool has a tier. ``requests``: request, body (JSON). A body that is no such JSON has no documents."""
    b = _blocks(requests, body)
    calls = b.where((F.col("role") == "assistant") & (_text("block", "type") == "tool_use")).select("request", "pos", _text("block", "id").alias("id"), _text("block", "name").alias("name"))
    content = F.get_json_object("block", "$.content")
    texts = F.when(_text("block", "content").isNotNull(), F.array(content)).otherwise(_texts(content, "text"))
    results = b.where((F.col("role") == "user") & (_text("block", "type") == "tool_result")).select("request", "pos", _text("block", "tool_use_id").alias("id"), F.to_json(texts).alias("text"))
    found = chatlog.correlate_messages(calls, results).withColumn("texts", F.from_json("text", "array<string>"))
    return _documents(found, provider, limit, False)


def responses_documents(requests: DataFrame, body: str = "body", limit: int = 64, provider: str = "openai") -> DataFrame:
    """The same of the other protocol: calls may follow, and an id that is called twice is void."""
    i = requests.select("request", F.posexplode(F.from_json(body, "struct<input:array<string>>").input).alias("pos", "block"))
    kind = _text("block", "type")
    calls = i.where(kind == "function_call").select("request", "pos", _text("block", "call_id").alias("id"), _text("block", "name").alias("name"))
    output = F.get_json_object("block", "$.output")
    texts = F.when(_text("block", "output").isNotNull(), F.array(output)).otherwise(_texts(output, "input_text"))
    results = i.where(kind == "function_call_output").select("request", "pos", _text("block", "call_id").alias("id"), F.to_json(texts).alias("text"))
    found = chatlog.correlate_responses(calls, results).withColumn("texts", F.from_json("text", "array<string>"))
    return _documents(found, provider, limit, True)
