"""Event-listing analytics: leaderboards, attendance, speakers, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalars as sc
from quillgraph.operators.skew import lookup_join, salted_join
from quillgraph.session import durable


def leaderboard(rows: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(key, num), largest first, ties by key."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("num")).orderBy(F.desc("num"), key)
    return out.limit(k) if k is not None else out


def active_groups(listing: DataFrame) -> DataFrame:
    return leaderboard(listing.filter(F.col("base_url") != ""), "base_url")


def attendance(listing: DataFrame, meta: DataFrame) -> DataFrame:
    """Attendance and event count per group and city, with the group's contact data.

    Events are summed per group and city before they meet ``meta``, so the join sees one
    row per pair however many events a group has.
    """
    per_group = (
        listing.filter(F.col("base_url") != "")
        .groupBy("base_url", "city")
        .agg(F.sum("reg").alias("_reg"), F.count(F.lit(1)).alias("_num"))
    )
    contacts = meta.select("base_url", "region", "contact", "email")
    joined = lookup_join(per_group, contacts, ["base_url"], "left", by=["city"])
    return (
        joined.groupBy("base_url", "region", "city", "contact", "email")
        .agg(F.sum("_reg").alias("attendance"), F.sum("_num").alias("num"))
        .orderBy(F.desc("attendance"), "base_url", "city", "region", "contact", "email")
    )


def speaker_counts(listing: DataFrame, k: int | None = None) -> DataFrame:
    """(speaker, num) over the ", "-separated speaker lists."""
    rows = listing.select(F.explode(F.split("speakers", ", ")).alias("speaker"))
    return leaderboard(rows, "speaker", k)


def at_url(listing: DataFrame, needle: str) -> DataFrame:
    """Events whose URL holds ``needle``, with its 0-based position."""
    found = listing.select("date", "title", "url", sc.url_position(F.col("url"), needle).alias("pos"))
    return found.filter(F.col("pos") > -1)


def clicks_of_registered(reg: DataFrame, clk: DataFrame) -> DataFrame:
    """Clicks joined to their registration on ``uuid``; an eager clicker is split over tasks."""
    return salted_join(
        clk.select("uuid", F.col("date").alias("clk_date"), F.col("n").alias("clk_n")),
        reg.select("uuid", F.col("date").alias("reg_date"), F.col("n").alias("reg_n"), "lat", "lon"),
        ["uuid"],
    )


def stratum_fractions(rows: DataFrame, key: str, num: int) -> DataFrame:
    """(key, n, fraction): share of each stratum to keep so that about ``num`` rows stay."""
    n = F.col("n")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "fraction", F.when(n < num, F.lit(1.0)).otherwise(F.lit(1.0) * num / n)
    )


def unit_value(*columns: str, seed: int = 42) -> Column:
    """A repeatable value in [0, 1): the first 52 bits of the MD5 of ``seed:column:...``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stratified_sample(rows: DataFrame, key: str, id_column: str, num: int, seed: int = 42) -> DataFrame:
    """About ``num`` rows of each stratum; smaller strata stay whole.  The same rows each run."""
    fractions = durable(stratum_fractions(rows, key, num))
    joined = lookup_join(
        rows, fractions.select(key, "fraction"), [key], by=[id_column], counts=fractions.select(key, "n")
    )
    return joined.filter(unit_value(id_column, seed=seed) < F.col("fraction")).drop("fraction")
