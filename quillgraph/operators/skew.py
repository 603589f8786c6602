"""Joins that stay balanced when one key holds a large share of the rows.

A key is *hot* when it owns more than one ``MAX_SHARE``-th of all rows, so there are
never more than ``MAX_SHARE`` hot keys: their list has a size bound that does not grow
with the data.  Only hot keys are split: their fact rows get a part number, and the
matching lookup rows are copied once per part.  No row is lost.

Hot keys are found before the join is planned, by counts that are there already or by Spark's own
frequent-items sketch: one pass that shuffles no key and keeps a bounded list in each task.  Where none is
hot the join is plain, and adaptive execution picks its kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

MAX_SHARE = 1024
MIN_ROWS = 100_000
#: items a task's sketch tracks; its counts are off by less than 4 rows in so many
SKETCH_ITEMS = 1 << 14
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
PART = "_part"
PARTS = "_parts"


def count_keys(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


class HotKeys:
    """The hot keys of a fact table, found once; serves any number of joins.

    ``counts`` holds one row per key with its row count ``n``.
    """

    def __init__(
        self, counts: DataFrame, keys: Sequence[str], *, max_share: int = MAX_SHARE, min_rows: int = MIN_ROWS
    ) -> None:
        self.keys = list(keys)
        limit = counts.agg(F.greatest(F.lit(float(min_rows)), F.sum("n") / max_share, F.lit(1.0))).scalar()
        hot = counts.filter((F.col("n") > limit) & ~_any_null(self.keys)).select(*self.keys, F.ceil(F.col("n") / limit).cast("int").alias(PARTS))
        rows = hot.collect()  # at most max_share rows
        self.any = bool(rows)
        self.table = counts.sparkSession.createDataFrame(rows, hot.schema)

    @classmethod
    def sketched(cls, facts: DataFrame, key: str, **bounds: int) -> HotKeys:
        """The hot values of one column, from a sketch of all rows."""
        k = bounds.get("max_share", MAX_SHARE)
        top = F.expr(f"approx_top_k(`{key}`, {k}, {max(SKETCH_ITEMS, k)})")
        seen = facts.agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
        items = [(r["item"], r["count"]) for r in seen["top"] or [] if r["item"] is not None]  # at most max_share
        rest = max(0, seen["n"] - sum(n for _, n in items))
        schema = StructType([StructField(key, facts.schema[key].dataType), StructField("n", LongType())])
        return cls(facts.sparkSession.createDataFrame([*items, (None, rest)], schema), [key], **bounds)

    def spread(self, facts: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
        """Add the part number of each fact row.

        ``by`` must tell the rows of one hot key apart, and the part must be the same
        when a lost task runs again, hence a hash and not a random number.  A left join
        keeps rows without a key, which would all meet in one task: they are spread too.
        """
        if not self._parted(how):
            return facts
        row_hash = F.xxhash64(*by)
        part = (
            F.when(_any_null(self.keys), F.pmod(row_hash, F.lit(MAX_SHARE)))
            .when(F.col(PARTS).isNotNull(), F.pmod(row_hash, F.col(PARTS)))
            .otherwise(F.lit(0))
        )
        marked = facts.join(F.broadcast(self.table), self.keys, "left")
        return marked.withColumn(PART, part.cast("int")).drop(PARTS)

    def replicate(self, lookup: DataFrame) -> DataFrame:
        """Copy each lookup row of a hot key once per part."""
        parts = F.sequence(F.lit(0), F.coalesce(F.col(PARTS), F.lit(1)) - 1)
        marked = lookup.join(F.broadcast(self.table), self.keys, "left")
        return marked.withColumn(PART, F.explode(parts)).drop(PARTS)

    def join_spread(self, spread_facts: DataFrame, lookup: DataFrame, how: str = "inner", on: Sequence[str] | None = None) -> DataFrame:
        """Join facts that went through ``spread`` before, on the hot keys or on more columns (``on``)."""
        keys = list(on or self.keys)
        if not self._parted(how):
            return spread_facts.join(lookup, keys, how)
        return spread_facts.join(self.replicate(lookup), [*keys, PART], how).drop(PART)

    def join(self, facts: DataFrame, lookup: DataFrame, by: Sequence[str], how: str = "inner", on: Sequence[str] | None = None) -> DataFrame:
        return self.join_spread(self.spread(facts, by, how), lookup, how, on)

    def _parted(self, how: str) -> bool:
        return self.any or how == "left"


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    by: Sequence[str] | None = None,
    counts: DataFrame | None = None,
    max_share: int = MAX_SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Equi-join of a fact table with a lookup table, hot fact keys split.

    Both tables name the keys alike.  ``how`` is ``inner`` or ``left``.  ``counts``
    (keys, n) spares the facts a pass; counts that are too high do no harm.  Without them the first key is
    sketched, as a hot combination has a hot first part.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    bounds = {"max_share": max_share, "min_rows": min_rows}
    hot = HotKeys.sketched(facts, keys[0], **bounds) if counts is None else HotKeys(counts, keys, **bounds)
    return hot.join(facts, lookup, by or facts.columns, how, keys)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to send to every executor, by looking at its rows."""
    size = F.length(F.to_json(F.struct(*df.columns)))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return seen["rows"] <= max_rows and seen["bytes"] <= max_bytes


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", *,
    by: Sequence[str] | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """As ``salted_join``, but a lookup table of checked small size is broadcast."""
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), list(keys), how)
    return salted_join(facts, lookup, keys, how, by=by, counts=counts)


def _any_null(keys: Sequence[str]) -> Column:
    test = F.lit(False)
    for k in keys:
        test = test | F.col(k).isNull()
    return test
