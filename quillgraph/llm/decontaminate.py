"""Benchmark passages in documents, by a prefix-filtered join of shingle sets.

Every item is cut into windows of ``window`` consecutive words (a shorter item is one window); a
window is the set of its ``shingle``-word shingles.  Shingles are ordered by how often the documents
have them.  A document passage contains a window only if it contains the window's whole set, so of a
set of n shingles the necessary prefix has n - n + 1 = 1: its rarest one.  Documents are joined with
the windows on that shingle alone; where it stands in the window fixes where the passage would
begin, which bounds position and length, and the words there are compared one by one.

Documents are read twice (to count shingles, to look for prefixes) and are never exploded into words: a
bitmap of the shingles sought, of bounded size, leaves only places that can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.word_hash import Words, runs
from quillgraph.operators.skew import lookup_join
from quillgraph.session import durable

WINDOW = 10
SHINGLE = 3
#: bits of the bitmap for each shingle sought, and the most bits (16 MiB) whatever their number
BITS_EACH = 64
MAX_BITS = 1 << 27
#: words are runs of 0-9, a-z and anything outside of ASCII, after A-Z are lower-cased
WORDS = Words(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))


def _text(raw: bytes, start: np.ndarray, end: np.ndarray) -> str:
    return b" ".join(raw[a:b].lower() for a, b in zip(start, end)).decode()


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, words, size, tokens): the windows of every item, words joined by spaces, with their shingles in order."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                raw = text.encode()
                value, start, end = WORDS.spans(raw)
                size = min(window, len(value))
                if not size:
                    continue
                tokens = runs(value, min(shingle, size)).view(np.int64)
                first = range(len(value) - size + 1)
                each = len(tokens) - len(first) + 1
                yield pd.DataFrame(
                    {
                        "item": item,
                        "words": [_text(raw, start[k : k + size], end[k : k + size]) for k in first],
                        "size": size,
                        "tokens": [tokens[k : k + each] for k in first],
                    }
                )

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(per_batch, "item string, words string, size int, tokens array<long>")


class _Bitmap:
    """Which tokens are sought; a few others pass too."""

    def __init__(self, tokens: DataFrame) -> None:
        wanted = max(1024, BITS_EACH * tokens.count())
        bits = min(MAX_BITS, 1 << (wanted - 1).bit_length())
        cells = tokens.select(F.pmod("token", F.lit(bits)).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("cell"))
        made = cells.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int))) AS mask"))
        table = made.toPandas()  # at most MAX_BITS / 64 cells
        mask = np.zeros(bits // 64, dtype=np.int64)
        mask[table["cell"].to_numpy(dtype=np.int64)] = table["mask"].to_numpy(dtype=np.int64)
        self.sent = tokens.sparkSession.sparkContext.broadcast((bits, mask))

    def has(self, tokens: np.ndarray) -> np.ndarray:
        bits, mask = self.sent.value
        at = tokens & np.int64(bits - 1)
        return (mask[at >> 6] >> (at & 63)) & 1 == 1


def _widths(sets: DataFrame, shingle: int) -> list[int]:
    sizes = sets.select(F.least("size", F.lit(shingle)).alias("w")).distinct().collect()  # at most ``shingle``
    return sorted(r["w"] for r in sizes)


def frequencies(docs: DataFrame, tokens: DataFrame, widths: list[int]) -> DataFrame:
    """(token, df): how often the documents have each of ``tokens``; summed in the tasks first."""
    sought = _Bitmap(tokens)

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                value = WORDS.spans(text.encode())[0]
                for w in widths:
                    token = runs(value, w).view(np.int64)
                    found.append(token[sought.has(token)])
            if not found:
                continue
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"token": token, "n": n})

    made = docs.filter(F.col("text").isNotNull()).select("text").mapInPandas(per_batch, "token long, n long")
    counts = made.groupBy("token").agg(F.sum("n").alias("df"))
    return tokens.join(counts, "token", "left").select("token", F.coalesce("df", F.lit(0)).alias("df"))


def prefixes(docs: DataFrame, sets: DataFrame, widths: list[int]) -> DataFrame:
    """(token, offset, size, words): every window under its rarest shingle (ties: the smaller hash, then the first place)."""
    each = sets.select("words", "size", F.posexplode("tokens").alias("offset", "token"))
    known = frequencies(docs, each.select("token").distinct(), widths)
    rarest = each.join(known, "token").groupBy("words", "size").agg(F.min(F.struct("df", "token", "offset")).alias("x"))
    return rarest.select("x.token", "x.offset", "size", "words")


def places(docs: DataFrame, prefix: DataFrame, widths: list[int], window: int) -> DataFrame:
    """(row, doc_id, n_words, found): one row per document with the places of sought shingles and the words around them."""
    sought = _Bitmap(prefix.select("token").distinct())

    def of_text(text: str) -> tuple[int, list[dict]]:
        raw = text.encode()
        value, start, end = WORDS.spans(raw)
        found = []
        for w in widths:
            token = runs(value, w).view(np.int64)
            for k in np.flatnonzero(sought.has(token)).tolist():
                a, b = max(0, k - window + w), min(len(value), k + window)
                found.append({"token": int(token[k]), "at": k, "first": a, "around": _text(raw, start[a:b], end[a:b])})
        return len(value), found

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [of_text(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [n for n, _ in made], "found": [f for _, f in made]})

    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(per_batch, "doc_id string, n_words long, found array<struct<token: long, at: int, first: int, around: string>>")
    return durable(made.withColumn("row", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id").cast("long")))


def occurrences(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row, words, start, stop): windows that stand in a document, verified word by word."""
    each = found.filter(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    met = lookup_join(each, prefix, ["token"], by=["row", "at"])
    start = F.col("at") - F.col("offset")
    bounded = met.withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    here = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("first") + 1, F.col("size")), " ")
    return bounded.filter(here == F.col("words")).select("row", "words", "start", (F.col("start") + F.col("size")).alias("stop"))


def _covered(spans):
    """Number of places inside any of the spans (start, stop), given in rising order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans, item_ids.

    ``spans`` are the word places (start, stop) of the item windows that stand in the text, ``n_hit``
    is the number of words inside any of them, ``item_ids`` are the items they belong to, as strings in
    rising order.  Null texts and texts without words have no words and hit nothing; so do null or
    wordless items.  A null item id counts as an empty one.  Repeated documents are rows of their own,
    repeated items count once.  Other columns are not read; an empty table of documents gives an empty
    table, one of items no hits.
    """
    cut = durable(windows(items, window, shingle))
    sets = cut.groupBy("words", "size").agg(F.first("tokens").alias("tokens"))
    widths = _widths(cut, shingle)
    prefix = durable(prefixes(docs, sets, widths))
    rows = places(docs, prefix, widths, window)
    hits = durable(occurrences(rows, prefix))
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    owners = cut.select("words", "item").distinct()
    named = lookup_join(hits.select("row", "words").distinct(), owners, ["words"], by=["row"]).select("row", "item").distinct()
    names = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    no_spans, no_items = F.array().cast("array<struct<start: int, stop: int>>"), F.array().cast("array<string>")
    some = rows.filter(F.size("found") > 0).join(spans, "row", "left").join(names, "row", "left")
    some = some.select("doc_id", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("item_ids", no_items).alias("item_ids"))
    none = rows.filter(F.size("found") == 0).select("doc_id", "n_words", no_spans.alias("spans"), no_items.alias("item_ids"))
    return some.unionByName(none).select("doc_id", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), "spans", "item_ids")
