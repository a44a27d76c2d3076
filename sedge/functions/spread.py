"""Where rows lie: spreading a scan of few splits, checkpoints in the shared folder, ordinals without one large window."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Only where none is set and all runs on one
    machine, as in tests, one is chosen here; on a cluster without one this is an error."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return at
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(at := os.path.join(tempfile.gettempdir(), "sedge-checkpoints"))
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a checkpoint: it is worked out once, and lost executors cost nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet: like a checkpoint it is worked out once and no executor's to lose, but
    its columns take a fraction of the disk that a checkpoint's rows do, and a reader takes only those it needs. It stays
    until the application ends."""
    spark = df.sparkSession
    at = os.path.join(shared_folder(spark), f"kept-{uuid.uuid4()}")
    df.write.option("compression", "zstd").parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan dealt out evenly if it has fewer splits than there are cores to work on them: a file of one row
    group is one task else, however dear the work on each row is. Scans of many splits stay as they are."""
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` to a number of partitions that stays as it is. Adaptive execution joins partitions by their
    bytes on disk; where rows are alike, or grow behind the shuffle, these say little of what a task will hold."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism), *keys)


def ordinals(rows: DataFrame, group: str, order: list[str], weight: str) -> DataFrame:
    """``rows`` with ``ordinal`` (from 1, by ``order`` within ``group``) and ``before``, the sum of ``weight`` so far.

    Rows are range-partitioned by group and order, so a group of any size spans partitions; what a partition adds is
    summed over one row for each group and partition. ``order`` must tell a group's rows apart, or ties are broken anyhow.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, group, *order).withColumn("_p", F.spark_partition_id()))
    earlier = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(group, "_p").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    base = sums.select(group, "_p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_w")])
    own = Window.partitionBy(group, "_p").orderBy(*order)
    so_far = F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.join(base.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")) & (dealt["_p"] == base["_p"])).drop(base["_p"])
    return out.select(*rows.columns, (F.row_number().over(own) + F.col("_n0")).alias("ordinal"), (so_far + F.col("_w0")).alias("before"))
