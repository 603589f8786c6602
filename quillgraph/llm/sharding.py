"""Shards of bounded size by extendible hashing.

The directory is indexed by the first bits of a row's hash.  A bucket over the byte limit is
split on its next bit, others are left alone, until every shard fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import computed, semi_join
from quillgraph.operators.skew import lookup_join
from quillgraph.session import durable

BITS = 60


def row_hash(*columns: str) -> Column:
    """60 bits of the MD5 of the columns as text, joined by ':'; null counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("long")


def _prefix(value: Column, depth: Column, of: int) -> Column:
    """The first ``depth`` bits of a value of ``of`` bits."""
    return F.call_function("shiftright", value, F.lit(of) - depth)


def directory(rows: DataFrame, limit: int, *, step: int = 6) -> list[tuple[int, DataFrame]]:
    """(depth of the cells, table of cell, depth, shard_bytes, shard_rows) for one or more cell depths.

    ``rows`` has _hash and _bytes.  A cell is a prefix some bits longer than an even spread would
    need; cells are summed once and the split is decided on them, each bit on its own.  Only
    cells over the limit are looked at again, with more bits.  Rows of one and the same hash
    cannot be told apart by it: such a bucket is a shard of its own, over the limit if they are.
    """
    total = rows.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    parts, start = [], 0
    while True:
        cells = durable(
            rows.groupBy(_prefix(F.col("_hash"), F.lit(depth), BITS).alias("cell")).agg(
                F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("_hash").alias("low"), F.max("_hash").alias("high")
            )
        )
        each = cells.select("*", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"))
        each = each.withColumn("bucket", _prefix(F.col("cell"), F.col("depth"), depth))
        sums = each.groupBy("depth", "bucket").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        fitting = sums.filter((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).drop("low", "high")
        found = each.select("cell", "depth", "bucket").join(fitting, ["depth", "bucket"])
        leaf = found.groupBy("cell").agg(F.min_by(F.struct("depth", "shard_bytes", "shard_rows"), "depth").alias("s"))
        parts.append((depth, durable(leaf.select("cell", "s.*"))))
        over = cells.filter((F.col("bytes") > limit) & (F.col("low") < F.col("high"))).select("cell")
        if depth == BITS or over.isEmpty():
            return parts
        rows = semi_join(rows.withColumn("cell", _prefix(F.col("_hash"), F.lit(depth), BITS)), over, ["cell"]).drop("cell")
        start, depth = depth + 1, min(BITS, depth + step)


def shard(docs: DataFrame, limit: int, *, key: tuple[str, ...] = ("doc_id", "text"), size: Column | None = None) -> DataFrame:
    """``docs`` with n_bytes, depth, shard and shard_bytes; columns of these names are replaced.

    ``shard`` is the string of the shard's hash bits (empty: all rows in one).  Null texts have
    0 bytes.  Equal rows have equal hashes and share a shard, the only kind (with a single row
    over the limit) that can exceed ``limit``.  An empty table gives an empty table.
    """
    own = ["n_bytes", "depth", "shard", "shard_bytes"]
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") if size is None else size
    base = computed(docs, _hash=row_hash(*key), _bytes=size)
    parts = directory(base.select("_hash", "_bytes"), limit)
    keep = [c for c in docs.columns if c not in own]
    rest = base.select(*keep, "_hash", "_bytes")
    out = None
    for depth, cells in parts:
        joined = lookup_join(rest.withColumn("cell", _prefix(F.col("_hash"), F.lit(depth), BITS)), cells, ["cell"], by=["_hash"])
        bits = F.lpad(F.conv(_prefix(F.col("_hash"), F.col("depth"), BITS).cast("string"), 10, 2), F.col("depth"), F.lit("0"))
        name = F.when(F.col("depth") == 0, F.lit("")).otherwise(bits)
        part = joined.select(*keep, F.col("_bytes").alias("n_bytes"), "depth", name.alias("shard"), "shard_bytes")
        out = part if out is None else out.unionByName(part)
    return out
