"""Sinks: canonical JSON lines, artifacts, and an authenticated cache of derived artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.udfs import hmac_hex, spaced_json


def json_lines(rows: DataFrame) -> DataFrame:
    """One column of JSON with sorted keys, a blank after each comma and colon, and nulls kept."""
    return rows.select(spaced_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("value"))


def publish(rows: DataFrame, path: str) -> None:
    """Write JSON lines where nothing is yet; the committer makes them visible at once, and an existing path is an error."""
    json_lines(rows).write.mode("errorifexists").text(path)


def cache_entries(artifacts: DataFrame, raw: str, settings_json: Column, key: bytes) -> DataFrame:
    """(entry_key, artifact, body, mac): ``artifacts`` (raw content, artifact, body) as they are stored."""
    entry = T.entry_key(F.sha2(raw, 256), settings_json)
    own = artifacts.withColumn("entry_key", entry)
    return own.select("entry_key", "artifact", "body", hmac_hex(F.concat_ws("|", "entry_key", "artifact", T.digest("body")), key).alias("mac"))


def cached(wanted: DataFrame, cache: DataFrame, key: bytes) -> DataFrame:
    """``wanted`` (entry_key, artifact) with ``state`` and ``body``: hit, miss, or quarantined where the MAC is wrong."""
    own = wanted.join(cache, ["entry_key", "artifact"], "left")
    good = hmac_hex(F.concat_ws("|", "entry_key", "artifact", T.digest("body")), key) == F.col("mac")
    own = own.withColumn("state", F.when(F.col("mac").isNull(), "miss").when(good, "hit").otherwise("quarantined"))
    return own.select("entry_key", "artifact", "state", F.when(F.col("state") == "hit", F.col("body")).alias("body"))
