"""Ranked key phrases for every document in one pass.

A document's word graph lives in its own row, so the ranks of all documents are found
without a shuffle: words are tagged, linked and ranked inside the task on bounded pieces of
Arrow batches, spans and phrases are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import arrow_text as at
from quillgraph.functions import text as tx
from quillgraph.operators.skew import fits_broadcast
from quillgraph.operators.text import words_of
from quillgraph.operators.user_functions import PhraseWalk, table_function

TOLERANCE = 1e-4
DAMPING = 0.85
LEVEL_PLACES = 9
RANKED = "array<struct<num:int,sent:int,raw:string,root:string,pos:string,kept:boolean,rank:double,level:double,first:boolean>>"


def _ranker(tol: float, max_rounds: int | None, distinct: bool):
    def batch_ranks(words, sizes, src, dst):
        """Ranks of all words of a run of documents, each document its own graph.

        ``words`` are dictionary codes, ``src`` and ``dst`` places of words.  Returns rank and first-sight flag per token.
        """
        width = int(words.max()) + 1 if len(words) else 1
        # vertices are numbered as they are first seen, so in document order
        vertex, keys = pd.factorize(np.repeat(np.arange(len(sizes)), sizes) * width + words)
        n = len(keys)
        seen_first = np.diff(np.maximum.accumulate(vertex), prepend=-1) > 0
        changes = np.diff(keys // width, prepend=-1) > 0
        doc_start, doc = np.flatnonzero(changes), np.cumsum(changes) - 1
        a, b = vertex[src], vertex[dst]
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        if distinct and len(a):
            a, b = np.divmod(pd.unique(a * n + b), n)
        share = DAMPING / np.maximum(np.bincount(a, minlength=n), 1)[a]
        rank = np.ones(n)
        live = np.ones(len(doc_start), dtype=bool)
        done = 0
        while n and done != max_rounds:
            done += 1
            fresh = (1 - DAMPING) + np.bincount(b, weights=rank[a] * share, minlength=n)
            change = np.maximum.reduceat(np.abs(fresh - rank), doc_start)
            rank = np.where(live[doc], fresh, rank)
            live &= change > tol
            if not live.any():
                break
            edge_live = live[doc[a]]
            if len(a) and edge_live.mean() < 0.7:  # finished documents leave the loop
                a, b, share = a[edge_live], b[edge_live], share[edge_live]
        return rank[vertex], seen_first

    return batch_ranks


def _rank_udf(links: str, tag: bool, tol: float, max_rounds: int | None, distinct: bool):
    batch_ranks = _ranker(tol, max_rounds, distinct)
    size = 3 if links == "tiles" else None

    def rank_tokens(toks: pa.Array) -> pa.Array:
        flat, ends, kept, (src, dst) = at.linked_words(toks, size)
        columns = {name: flat.field(name) for name in ("num", "sent", "raw", "root", "pos")}
        roots = pc.if_else(pa.array(kept), columns["root"].cast(pa.string()), "")
        codes = roots.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rank, seen_first = batch_ranks(codes, np.diff(ends), src, dst)
        rank = np.where(kept, rank, 0.0)
        # level is for comparing: words that tie stay tied whatever the order of the sums
        return at.lists_of(ends, {**columns, "kept": kept, "rank": rank, "level": np.round(rank, LEVEL_PLACES), "first": kept & seen_first}, toks)

    return at.by_pieces(RANKED, rank_tokens, tag)


def ranked_tokens(
    docs: DataFrame,
    toks: str = "toks",
    *,
    links: str = "tiles",
    distinct: bool = True,
    tol: float = TOLERANCE,
    max_rounds: int | None = None,
) -> DataFrame:
    """Add ``ranked``: the document's tokens with rank and first-sight flag.

    ``links`` is ``tiles`` (kept words up to three apart, one edge per pair when
    ``distinct``) or ``window`` (three-word windows; use ``distinct=False`` so that a
    repeated pair weighs more).  Words that are not kept have rank 0.  Rounds go on until no rank
    of a document moves by more than ``tol``; ``max_rounds`` is a limit only if the caller sets one.
    """
    if links not in ("tiles", "window"):
        raise ValueError("links must be tiles or window")
    words, tag = words_of(docs) if toks == "toks" else (F.col(toks), False)
    return docs.withColumn("ranked", _rank_udf(links, tag, tol, max_rounds, distinct)(words))


def word_ranks(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document and kept word: (doc, root, rank)."""
    words = F.filter("ranked", lambda t: t["first"])
    return (
        ranked.select(doc, F.explode_outer(words).alias("t"))
        .filter(F.col("t").isNotNull())
        .select(doc, F.col("t.root").alias("root"), F.col("t.rank").alias("rank"))
    )


def ranks_and_counts(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Word ranks beside plain word counts: (doc, root, num, rank); rank 0 if never kept."""
    words = ranked.select(doc, F.explode_outer("ranked").alias("t")).filter(F.col("t").isNotNull())
    return words.groupBy(doc, F.col("t.root").alias("root")).agg(
        F.count(F.lit(1)).alias("num"), F.max("t.rank").alias("rank")
    )


def _spans(ranked: Column, flags: Column, break_at_sentence: bool = False) -> Column:
    """Runs of flagged tokens as array<struct<phrase, start, rank, nouns>>; a sentence can end them."""
    new = lambda t, i: (i == 0) | (t["sent"] != F.get(ranked, i - 1)["sent"])
    starts = F.transform(ranked, new) if break_at_sentence else None

    def span(run: Column) -> Column:
        return tx.let(
            F.slice(ranked, run["start"] + 1, run["len"]),
            lambda part: F.struct(
                F.array_join(F.transform(part, lambda t: t["raw"]), " ").alias("phrase"),
                run["start"].alias("start"),
                F.round(F.aggregate(F.transform(part, lambda t: t["rank"]), F.lit(0.0), lambda s, r: s + r), LEVEL_PLACES).alias("rank"),
                F.exists(part, lambda t: t["pos"].startswith("N")).alias("noun"),
            ),
        )

    return F.transform(tx.runs(flags, starts), span)


def _last_of_each(spans: Column) -> Column:
    """Of the spans with one phrase, the last in the text: sort, then keep group ends."""
    ordered = F.array_sort(spans)

    def ends(s: Column) -> Column:
        following = F.concat(F.slice(F.transform(s, lambda x: x["phrase"]), 2, F.size(s)), F.array(F.lit(None).cast("string")))
        return F.filter(
            F.zip_with(s, following, lambda x, nxt: F.when(nxt.isNull() | (x["phrase"] != nxt), x)), lambda x: x.isNotNull()
        )

    return tx.let(ordered, ends)


def _shares(spans: Column) -> Column:
    def divide(s: Column) -> Column:
        total = F.aggregate(F.transform(s, lambda x: x["rank"]), F.lit(0.0), lambda t, r: t + r)
        return tx.let(
            total,
            lambda t: F.transform(s, lambda x: F.struct(x["phrase"].alias("phrase"), (x["rank"] / t).alias("norm_rank"))),
        )

    return tx.let(spans, divide)


def _phrase_rows(ranked: DataFrame, doc: str, phrases: Column) -> DataFrame:
    return (
        ranked.select(doc, F.explode_outer(phrases).alias("p"))
        .filter(F.col("p").isNotNull())
        .select(doc, F.col("p.phrase").alias("phrase"), F.col("p.norm_rank").alias("norm_rank"))
    )


def noun_phrases(ranked: DataFrame, doc: str = "doc_id", *, break_at_sentence: bool = False) -> DataFrame:
    """Runs of kept words with at least one noun, lower-cased, shares of the document's rank.

    A phrase met twice has the rank of its last span.  Signs take no position, so a run goes on over the
    end of a sentence unless ``break_at_sentence``.
    """
    kept = F.transform("ranked", lambda t: t["kept"])
    spans = F.filter(_spans(F.col("ranked"), kept, break_at_sentence), lambda s: s["noun"])
    lowered = F.transform(
        spans,
        lambda s: F.struct(F.lower(s["phrase"]).alias("phrase"), s["start"].alias("start"), s["rank"].alias("rank")),
    )
    return _phrase_rows(ranked, doc, _shares(_last_of_each(lowered)))


def phrase_spans(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, phrase, start, noun): every run of kept words, with the position of its first word."""
    spans = _spans(F.col("ranked"), F.transform("ranked", lambda t: t["kept"]))
    rows = ranked.select(doc, F.explode_outer(spans).alias("s")).filter(F.col("s").isNotNull())
    return rows.select(doc, "s.phrase", "s.start", "s.noun")


def walked_spans(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """As ``phrase_spans``, by a table function over the words of each text in order.

    The words of a text lie in order as they come out of its row, so only words of keys that several texts have
    are shuffled, to be read as one text.  These keys are counted first, without the texts.
    """
    shared = ranked.groupBy(F.col(doc).alias("_doc")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_doc")
    same = F.col(doc).eqNullSafe(F.col("_doc"))

    def walk(texts: DataFrame, **options) -> DataFrame:
        words = texts.select(F.col(doc).alias("doc"), F.explode_outer("ranked").alias("t")).filter(F.col("t").isNotNull())
        rows = words.select("doc", "t.num", "t.raw", "t.pos", "t.kept")
        kind = ranked.schema[doc].dataType.simpleString()
        walked = table_function(rows, PhraseWalk, f"doc {kind}, phrase string, start int, noun boolean", batches=True, **options)
        return walked.withColumnRenamed("doc", doc)

    if shared.isEmpty():
        return walk(ranked, keys=[])
    together = {"keys": ["doc"], "order": ["num"]}
    if not fits_broadcast(shared):
        return walk(ranked, **together)
    alone = walk(ranked.join(F.broadcast(shared), same, "left_anti"), keys=[])
    return alone.unionByName(walk(ranked.join(F.broadcast(shared), same, "left_semi"), **together))


def summary_phrases(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Runs of words ranked at or above the document's median; of those the upper half."""
    floor = tx.median(F.transform(F.filter("ranked", lambda t: t["first"]), lambda t: t["level"]))
    with_floor = ranked.withColumn("_floor", floor)
    flags = F.transform("ranked", lambda t: t["kept"] & (t["level"] >= F.col("_floor")))
    plain = F.transform(
        _spans(F.col("ranked"), flags),
        lambda s: F.struct(s["phrase"].alias("phrase"), s["start"].alias("start"), s["rank"].alias("rank")),
    )

    def upper_half(s: Column) -> Column:
        return tx.let(tx.median(F.transform(s, lambda x: x["rank"])), lambda m: F.filter(s, lambda x: x["rank"] >= m))

    return _phrase_rows(with_floor, doc, _shares(tx.let(_last_of_each(plain), upper_half)))
