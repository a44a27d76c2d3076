"""Sources: text files, JSON artifacts, framed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.udfs import canonical_json, strict_json


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, content, text, sha256, bytes), each file once; bytes that are no UTF-8 are replaced in the text."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).dropDuplicates(["path"])
    return own.select(F.col("path").alias("source"), "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def checked_spool(files: DataFrame, max_documents: int = 64, max_bytes: int = 2_000_000, max_total: int = 16 * 1024 * 1024) -> DataFrame:
    """``files`` if it keeps within its bounds, which are errors to exceed: documents, bytes of each, bytes of all, and
    UTF-8 throughout. One small aggregate is looked at before anything else runs."""
    n = files.agg(F.count("*").alias("n"), F.max("bytes").alias("most"), F.sum("bytes").alias("total"), F.count_if(~F.is_valid_utf8(F.col("content").cast("string"))).alias("bad")).first()
    for what, found, limit in (("documents", n.n, max_documents), ("bytes of a document", n.most or 0, max_bytes), ("bytes in total", n.total or 0, max_total), ("documents that are no UTF-8", n.bad, 0)):
        if found > limit:
            raise ValueError(f"{found} {what}; the limit is {limit}")
    return files


def jsonish(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, pos, value): a file's JSON value, or if it is not one, each line's, blank lines passed over.

    ``value`` is the text; it is null where a line is no JSON.
    """
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("source"), "value").withColumn("_ok", canonical_json("value").isNotNull())
    lines = F.when(F.col("_ok"), F.array("value")).otherwise(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != ""))
    rows = whole.select("source", F.posexplode_outer(lines).alias("pos", "value")).where("value is not null")
    return rows.withColumn("value", F.when(canonical_json("value").isNotNull(), F.col("value")))


def strict_artifacts(files: DataFrame, max_bytes: int = 4 * 1024 * 1024) -> DataFrame:
    """``files`` with ``json`` (canonical) and ``error``: too large, not UTF-8, or not strict JSON."""
    text = F.col("content").cast("string")
    error = F.when(F.col("bytes") > max_bytes, "too-large").when(~F.is_valid_utf8(text), "not-utf8")
    own = files.withColumn("error", error).withColumn("json", strict_json(F.when(F.col("error").isNull(), text)))
    return own.withColumn("error", F.coalesce("error", F.when(F.col("json").isNull(), "not-strict-json")))


def completed_response(artifacts: DataFrame, json: str = "json") -> DataFrame:
    """Usage of completed-response artifacts (bare, or inside a completion event); others come back with an error."""
    at = lambda p: F.get_json_object(json, p)
    event = at("$.type")
    body = F.when(event.isNull(), F.col(json)).when(event == "response.completed", at("$.response"))
    own = artifacts.withColumn("_b", body)
    b = lambda p: F.get_json_object("_b", p)
    ok = (b("$.status") == "completed") & (b("$.object") == "response") & b("$.usage").isNotNull()
    fields = {"input_tokens": "input_tokens", "cached_input_tokens": "input_tokens_details.cached_tokens", "cache_write_tokens": "input_tokens_details.cache_write_tokens", "output_tokens": "output_tokens", "reasoning_output_tokens": "output_tokens_details.reasoning_tokens", "total_tokens": "total_tokens"}
    own = own.withColumn("usage_error", F.when(~F.coalesce(ok, F.lit(False)), "not-a-completed-response")).withColumn("model", b("$.model"))
    return own.withColumns({f: F.when(F.col("usage_error").isNull(), b(f"$.usage.{p}").cast("long")) for f, p in fields.items()}).drop("_b")


def agent_turns(lines: DataFrame, key: str = "source") -> DataFrame:
    """Usage of agent logs (key, pos, value): exactly one completed turn, and an agent message before it."""
    kind = F.get_json_object("value", "$.type")
    done = kind == "turn.completed"
    message = (kind == "item.completed") & (F.get_json_object("value", "$.item.type") == "agent_message")
    out = lines.groupBy(key).agg(F.count_if(done).alias("turns"), F.max_by("value", F.when(done, F.col("pos"))).alias("_d"), F.max_by(F.get_json_object("value", "$.item.text"), F.when(message, F.col("pos"))).alias("final_message"))
    ok = (F.col("turns") == 1) & F.col("final_message").isNotNull()
    return out.select(key, ok.alias("valid"), F.when(ok, F.col("final_message")).alias("final_message"), *[F.when(ok, F.get_json_object("_d", f"$.usage.{f}").cast("long")).alias(f) for f in ("input_tokens", "cached_input_tokens", "output_tokens")])


def last_result(lines: DataFrame, key: str = "source") -> DataFrame:
    """The last result of each log, and how often a call was tried again."""
    kind = F.get_json_object("value", "$.type")
    return lines.groupBy(key).agg(F.max_by("value", F.when(kind == "result", F.col("pos"))).alias("result"), F.count_if((kind == "system") & (F.get_json_object("value", "$.subtype") == "api_retry")).alias("retries"))
