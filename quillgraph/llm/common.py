"""Word splitting, labelled samples and joins that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import BROADCAST_ROWS

WORD_GAP = r"[\x20\x09-\x0D]+"

_HASH_RANGE = 1 << 30


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` runs of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def count_where(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` in the regex class ``chars`` (given without brackets)."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once for a row, whatever is asked of them.

    A plain column would be written out again inside every filter and key that uses it, and a
    text would be split many times over.  The one-element ``explode`` keeps it apart.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, made.alias("_made")).select(*kept, *[F.col("_made")[n].alias(n) for n in columns])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def labelled_sample(labels: DataFrame, label: str, max_rows: int, usable: Column | None = None) -> DataFrame:
    """(doc_id, y) of about ``max_rows`` labelled documents, or all if there are fewer.

    The sample is a hash range of the ids, hence the same on every run.  A document labelled
    more than once gets its largest label; labels other than 0 and 1 are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    return known.filter(in_sample(known, max_rows, "doc_id"))


def in_sample(rows: DataFrame, max_rows: int, *keys: str) -> Column:
    """Whether a row lies in the hash range that holds about ``max_rows`` of ``rows``."""
    share = min(1.0, max_rows / max(1, rows.count()))
    return F.pmod(F.xxhash64(*keys), F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE)


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The documents of a labelled sample.  The sample is bounded by its parameter, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def small(rows: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of narrow rows has few enough of them to broadcast."""
    return rows.limit(max_rows + 1).count() <= max_rows


def semi_join(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in ``ids`` (nulls equal); ``ids`` is broadcast only if counted small."""
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(ids[k])
    return rows.join(F.broadcast(ids) if small(ids) else ids, same, "left_semi")
