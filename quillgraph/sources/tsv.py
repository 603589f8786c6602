"""Tab-separated tables: event listings, group metadata, click and register files.

A plain split on tabs: quotes are data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalars as sc

REGISTER = "date string, uuid string, n int, lat double, lon double"
CLICK = "date string, uuid string, n int"


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split("value", "\t").alias("f"))


def event_rows(lines: DataFrame, *, accept_https: bool = False) -> DataFrame:
    """Event listing from text lines; the header has ``date`` in its first field."""
    at = lambda i: F.get("f", F.lit(i))
    return _fields(lines).filter(at(0) != "date").select(
        at(0).alias("date"),
        at(1).alias("time"),
        at(2).alias("title"),
        at(3).alias("speakers"),
        at(4).alias("affil"),
        at(5).alias("addr"),
        at(6).alias("url"),
        sc.base_url(at(6), accept_https=accept_https).alias("base_url"),
        sc.int_or_zero(at(8)).alias("reg"),
        at(9).alias("city"),
    )


def meta_rows(lines: DataFrame) -> DataFrame:
    """Group metadata from text lines; the header has ``region`` in its first field."""
    at = lambda i: F.get("f", F.lit(i))
    return _fields(lines).filter(at(0) != "region").select(
        at(5).alias("base_url"),
        at(0).alias("region"),
        sc.contact_name(at(6)).alias("contact"),
        sc.contact_address(at(6)).alias("email"),
    )


def read_events(spark: SparkSession, path: str, *, accept_https: bool = False) -> DataFrame:
    return event_rows(spark.read.text(path), accept_https=accept_https)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return meta_rows(spark.read.text(path))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=REGISTER, quote="")


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=CLICK, quote="")


def write_tsv(df: DataFrame, path: str) -> None:
    """Rows as headerless tab-separated lines, without quotes; a null is an empty field."""
    df.write.mode("overwrite").csv(path, sep="\t", header=False, quote="", emptyValue="")
