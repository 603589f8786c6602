"""Columnar tables: scan and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fill_slots(df: DataFrame) -> DataFrame:
    """Spread a scan over all task slots when it has fewer splits than slots.

    Meant for costly per-row work on a few large row groups, directly on a scan (asking a
    shuffled plan for its splits would run it).  A scan with enough splits,
    as any large table has, is left alone and nothing is shuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def write_table(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write a table in ``buckets`` sorted files by a hash of ``keys`` and return it.

    Joins on the keys read it as it lies: no exchange of this side, as long as there are at least as many
    buckets as shuffle partitions.  ``name`` is registered in the session's catalog, replacing one there.
    """
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
    dealt.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
