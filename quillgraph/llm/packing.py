"""Packing by optimal length buckets.

A global histogram of lengths goes through a dynamic programme that picks the bucket
boundaries with the least padding; inside a bucket, documents form batches of a fixed number
of padded tokens.  The histogram has one cell for each distinct length; m of them need at
least m * (m - 1) / 2 words, so it is short beside the texts however long they get.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import computed, words

CHUNK_ROWS = 8192


def word_length(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def histogram(docs: DataFrame, length: Column) -> list[tuple[int, int, int]]:
    """(length, rows, summed length) of each distinct length in order."""
    cells = computed(docs, n=length).select("n").groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    return sorted((r["n"], r["rows"], r["n"] * r["rows"]) for r in cells.collect())


def boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``best[j]`` is the least padding of the first j cells with the buckets allowed so far.  One
    bucket more takes the minimum over i of ``best[i] + seen[i] - rows[i] * top``: lines in top,
    the longest length of the last bucket.  Their slopes fall with i and top rises with j, so
    the lower hull is walked once a round, in exact integers.
    """
    if not cells:
        return []
    m, rows, seen = len(cells), [0], [0]
    for _, n, total in cells:
        rows.append(rows[-1] + n)
        seen.append(seen[-1] + total)
    best = [0] + [cells[j - 1][0] * rows[j] - seen[j] for j in range(1, m + 1)]
    starts = [array("q", [0]) * (m + 1)]
    for _ in range(1, min(buckets, m)):
        hull, at, after, start = [], 0, [0], array("q", [0])
        for j in range(1, m + 1):
            slope, level = -rows[j - 1], best[j - 1] + seen[j - 1]
            while len(hull) > at + 1 and (level - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, level, j - 1))
            top = cells[j - 1][0]
            while at + 1 < len(hull) and hull[at + 1][0] * top + hull[at + 1][1] <= hull[at][0] * top + hull[at][1]:
                at += 1
            after.append(hull[at][0] * top + hull[at][1] + top * rows[j] - seen[j])
            start.append(hull[at][2])
        best = after
        starts.append(start)
    ends, j = [], m
    while j > 0:
        ends.append(cells[j - 1][0])
        j = starts.pop()[j]
    return ends[::-1]


def pack(
    docs: DataFrame,
    *,
    length: Column | None = None,
    buckets: int = 16,
    batch_tokens: int = 65_536,
    order_by: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``docs`` with n_tokens, bucket, padded_length and batch; columns of these names are replaced.

    A batch holds ``max(1, batch_tokens // padded_length)`` documents of one bucket (as many as
    fit the budget; a longer document is a batch of its own), only the last one of a bucket
    fewer.  Null and empty texts have length 0 and pad to their bucket like any other; repeated
    rows stay separate rows.  An empty table gives an empty table.

    Places in a bucket come from hash chunks of about ``CHUNK_ROWS`` rows and the sizes of the
    chunks before, so no task sees a whole bucket.
    """
    own = ["n_tokens", "bucket", "padded_length", "batch"]
    length = word_length(F.col("text")) if length is None else length
    ends = boundaries(histogram(docs, length), buckets)
    base = computed(docs, n_tokens=length).select(*[c for c in docs.columns if c not in own], "n_tokens")
    if not ends:
        none = F.lit(None).cast("long")
        return base.select("*", none.cast("int").alias("bucket"), none.alias("padded_length"), none.alias("batch"))
    edges = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
    rows = computed(base, bucket=bucket).withColumn("padded_length", F.get(edges, F.col("bucket")))
    spread = F.xxhash64(*order_by, "n_tokens")
    sizes = rows.groupBy("bucket").count().collect()  # one row a bucket
    chunks = F.coalesce(*[F.when(F.col("bucket") == r["bucket"], r["count"] // CHUNK_ROWS + 1) for r in sizes], F.lit(1))
    rows = rows.withColumn("_spread", spread).withColumn("_chunk", F.pmod("_spread", chunks))
    counts = rows.groupBy("bucket", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy("bucket").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("bucket", "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("bucket", "_chunk").orderBy("_spread", *order_by)) - 1
    placed = rows.withColumn("_place", place).join(offsets, ["bucket", "_chunk"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest("padded_length", F.lit(1))))
    batch = F.floor((F.col("_before") + F.col("_place")) / capacity).cast("long")
    return placed.select(*base.columns, "bucket", "padded_length", batch.alias("batch"))
