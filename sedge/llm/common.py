"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.spread import cut, shared_folder, spread  # noqa: F401  (for the operators here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever kind of file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts(df: DataFrame) -> int:
    """Shuffle partitions to ask for where an explicit number is needed."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterable[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a task holds stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_key(text: str = "text"):
    """With the id, tells apart different texts that carry the same id; a null text has a key too."""
    return F.xxhash64(F.col(text))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that a result is about to add (names compare without case, as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it until no table has a column of that name."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def split_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has a key once, so that AQE may split a hot key's rows of ``big``.

    AQE splits a join only where both sides come straight out of a shuffle made for it. A side that was aggregated by the
    key would keep its partitioning; a further key, which follows from the first, makes Spark deal out both sides anew.
    """
    more = F.pmod(F.xxhash64(keys[0]), F.lit(1 << 30)).alias("_deal")
    return big.select("*", more).join(small.select("*", more), [*keys, "_deal"], how).drop("_deal")
