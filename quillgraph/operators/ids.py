"""Dense ids for the distinct values of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.session import durable

_ROW_BITS = (1 << 33) - 1


def dense_ids(values: DataFrame, key: str, id_name: str = "id", *, first: int = 0, partitions: int | None = None, counts: str | None = None) -> DataFrame:
    """One row per distinct non-null ``key`` with an id ``first, first+1, ...`` in key order.

    The keys are range-sorted; an id is the row's place in its partition plus the sizes
    of the partitions before it, so no task ever holds the whole list.  The sorted keys
    are made durable first: sizes and places then come from the same sort.  The result
    also has ``n``, the number of input rows of the key, or the sum of their ``counts``.
    """
    spark = values.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = values.filter(F.col(key).isNotNull()).groupBy(key).agg((F.sum(counts) if counts else F.count(F.lit(1))).alias("n"))
    placed = durable(
        counts.repartitionByRange(partitions, key)
        .sortWithinPartitions(key)
        .withColumn("_place", F.monotonically_increasing_id())
        .select(
            key,
            "n",
            F.shiftright("_place", 33).alias("_slice"),
            F.col("_place").bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
        )
    )
    # one row per partition of the sort, whatever the number of keys
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_slice").select(
        (F.col("_offset") + F.col("_row") + first).cast("long").alias(id_name), key, "n"
    )
