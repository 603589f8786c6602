"""Token counts without token ids.

A byte-pair tokenizer never merges across pre-tokens, so a text has as many tokens as its
pre-tokens have pieces.  Each distinct pre-token of the corpus goes through the tokenizer
once; the per-document frequencies are joined to those piece counts and summed.

Pre-tokens that make up at least ``1/HEAVY_PARTS`` of all (so at most ``HEAVY_PARTS`` of
them) are sent to the tasks and joined there; the rest, a small share of the rows and none
of them hot, are joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import durable

HEAVY_PARTS = 1 << 19
_BATCH = 4096


def pretokenizer(pattern: str, specials: tuple[str, ...]) -> Callable[[str], Counter]:
    """A function from a text to the frequencies of its pre-tokens; special strings stay whole."""
    import regex

    find = regex.compile(pattern).findall
    cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else None

    def frequencies(text: str) -> Counter:
        if cut is None or not any(s in text for s in specials):
            return Counter(find(text))
        out: Counter = Counter()
        for k, part in enumerate(cut(text)):
            out.update((part,) if k % 2 else find(part))
        return out

    return frequencies


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, *, specials: tuple[str, ...] = (), limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``pattern`` and ``specials`` are those of the tokenizer file: the pre-token pattern and the
    strings that are one token each.  A null text counts as empty: 0 bytes, 0 tokens.  Texts
    are whole however long; repeated rows stay separate rows; other columns are not read.
    """
    counts = durable(_pieces(_distinct(docs, pattern, specials), tokenizer_path))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(1, total / HEAVY_PARTS)
    heavy = {r["token"]: r["pieces"] for r in counts.filter(F.col("n") >= bound).select("token", "pieces").collect()}
    known = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY_PARTS entries

    def per_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, pieces = pretokenizer(pattern, specials), known.value
        for batch in batches:
            row, token, times, sums = [], [], [], []
            for r, text in zip(batch["row"], batch["text"]):
                done = 0
                for t, n in split(text).items():
                    p = pieces.get(t)
                    if p is None:
                        row.append(r)
                        token.append(t)
                        times.append(n)
                    else:
                        done += n * p
                sums.append(done)
            none = pd.Series([None] * len(row), dtype="Int64")
            yield pd.DataFrame({"row": row, "token": pd.Series(token, dtype=object), "times": times, "doc_id": none, "n_bytes": none, "done": 0})
            # the row itself; a pre-token never continues a NUL with a digit, so this joins with nothing
            own = pd.Series([f"\x00{r}" for r in batch["row"]], dtype=object)
            yield pd.DataFrame({"row": batch["row"], "token": own, "times": 0, "doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"].astype("Int64"), "done": sums})

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    parts = numbered.mapInPandas(per_document, "row long, token string, times long, doc_id long, n_bytes long, done long")
    rest = counts.filter(F.col("n") < bound).select("token", "pieces")
    joined = parts.join(rest, "token", "left")
    n_tokens = (F.sum("done") + F.sum(F.col("times") * F.coalesce("pieces", F.lit(0)))).cast("long")
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _distinct(docs: DataFrame, pattern: str, specials: tuple[str, ...]) -> DataFrame:
    """(token, n): the distinct pre-tokens of all texts, added up per batch before the shuffle."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = pretokenizer(pattern, specials)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update(split(text))
            yield pd.DataFrame({"token": pd.Series(list(seen.keys()), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    texts = docs.select("text").filter(F.col("text").isNotNull())
    return texts.mapInPandas(per_batch, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _pieces(distinct: DataFrame, tokenizer_path: str) -> DataFrame:
    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            tokens, sizes = batch["token"].tolist(), []
            for k in range(0, len(tokens), _BATCH):
                sizes += map(len, tokenizer.encode_batch(tokens[k : k + _BATCH], add_special_tokens=False))
            yield pd.DataFrame({"token": pd.Series(tokens, dtype=object), "n": batch["n"], "pieces": sizes})

    return distinct.mapInPandas(per_batch, "token string, n long, pieces int")
