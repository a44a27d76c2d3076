"""What only ever grows: audit logs and queues of jobs, out of streams.

A micro-batch appends a folder of its own, named by the writer and the batch's number. One that Spark runs again, because
the driver was lost before it noted the end, finds its folder whole and leaves it, or half written and writes it anew: a row
is appended once, and no reader sees the rows of a batch that did not end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sedge.functions import text as T
from sedge.sources.sinks import json_lines

#: What a queued job may do: nothing until someone allows it.
AUTHORIZATION = "queued-not-authorized"
JOB = ("id", "created_at", "repo", "tool", "budget_tokens", "prompt", "redactions", "flags", "authorization")
PROMPT_COLUMNS = ("id", "created_at", "repo", "tool", "budget_tokens")


def _whole(spark: SparkSession, folder: str) -> bool:
    """Whether the committer has marked a folder as done."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


def append_batch(rows: DataFrame, batch: int, path: str, writer: str) -> bool:
    """Append the rows of one batch as lines of JSON, once; whether this call wrote them. No rows: an empty folder."""
    folder = f"{path.rstrip('/')}/writer={writer}/batch={batch}"
    if _whole(rows.sparkSession, folder):
        return False
    json_lines(rows).write.mode("overwrite").text(folder)
    return True


def append(stream: DataFrame, path: str, checkpoint: str, writer: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataStreamWriter:
    """A writer of ``stream`` that appends ``make`` of each micro-batch below ``path``. Writers with other names may append
    to the same path; a name belongs to one ``checkpoint``, for batches are counted there."""
    return stream.writeStream.foreachBatch(lambda rows, batch: append_batch(make(rows), batch, path, writer) and None).option("checkpointLocation", checkpoint)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """(value, writer, batch): every line of the batches that ended. Half written folders have no rows: the committer moves
    files into place at the end."""
    return spark.read.schema("value string, writer string, batch long").text(path)


def audit_lines(records: DataFrame, clock: str = "ts") -> DataFrame:
    """``records`` with the time at which they were judged, in UTC, where they do not bring one."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return records if clock in records.columns else records.withColumn(clock, now)


def queued(prompts: DataFrame) -> DataFrame:
    """Jobs (``JOB``) out of prompts (id, created_at, repo, tool, budget_tokens, prompt): the prompt is redacted before it is
    kept or sent anywhere, and the job is not allowed to run.

    Of prompts with one id the last by ``created_at`` counts, of several at that time the one whose kept text is largest; a
    prompt without a time comes before all others. Without an id it is named by the digest of what is kept. A null prompt
    is an empty one. Columns that are missing are null, others are passed over.
    """
    own = prompts.select(*[F.col(c) if c in prompts.columns else F.lit(None).cast("string").alias(c) for c in PROMPT_COLUMNS], F.coalesce("prompt", F.lit("")).alias("_raw"))
    clean = T.redact(own, "_raw", "prompt", "redactions").drop("_raw")
    clean = clean.withColumn("id", F.coalesce("id", F.concat(F.lit("job-"), F.substring(T.digest("prompt"), 1, 16)))).withColumns({"flags": T.flags(F.col("prompt"), F.col("redactions")), "authorization": F.lit(AUTHORIZATION)})
    last = clean.groupBy("id").agg(F.max(F.struct(F.col("created_at").isNotNull().alias("_timed"), "created_at", "prompt", *[c for c in JOB if c not in ("id", "created_at", "prompt")])).alias("_j"))
    return last.select(*[F.col("id") if c == "id" else F.col(f"_j.{c}") for c in JOB])
