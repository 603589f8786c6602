"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings.  Sentences of labelled
documents that name a group are copied with the name of another group of the same kind; the
squared change of the score between the two is a penalty, so the weights of such names move
towards each other and a mention alone does not raise the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import labelled_sample, with_labels
from quillgraph.llm.linear import BLOCK, PARTITIONS, Examples, block, minimise, sigmoid, sums
from quillgraph.session import durable

#: kinds of group names; a name is swapped for the next of its kind
IDENTITIES = [
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "female male transgender nonbinary".split(),
    "gay straight lesbian bisexual queer".split(),
    "black white asian latino arab indigenous".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "african american european mexican chinese indian turkish".split(),
    "old young elderly".split(),
    "blind deaf disabled autistic".split(),
    "immigrant refugee foreigner native".split(),
    "frauen männer mädchen jungen".split(),
    "femmes hommes filles garçons".split(),
    "mujeres hombres niñas niños".split(),
]
SWAP = {name: kind[(k + 1) % len(kind)] for kind in IDENTITIES for k, name in enumerate(kind)}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_STARTS = (4, 5, 6, 7)


def features(words: set) -> set:
    return words | {f"{w[:n]}_" for n in _STARTS for w in words if len(w) > n}


def word_set(text: str) -> set:
    return set(_WORD.findall(text.lower()))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    *,
    max_labelled: int = 30_000,
    max_features: int = 4096,
    fairness: float = 1.0,
    ridge: float = 1e-3,
    positive_weight: float = 2.0,
    rounds: int = 50,
) -> tuple[dict[str, int], np.ndarray]:
    """(feature numbers, weights with the intercept last).

    Learns from at most about ``max_labelled`` labelled rows (a hash sample of those where
    ``usable`` holds); features are the ``max_features`` whose share differs most between the
    labels.  Without rows of both labels every weight is 0 but the intercept.
    """
    sample = labelled_sample(labels, "toxic", max_labelled, usable)
    rows = with_labels(docs, sample).filter(F.col("text").isNotNull()).select("text", "y")
    vocabulary = _vocabulary(rows, max_features)
    n = len(vocabulary) + 1
    blocks = durable(rows.mapInPandas(_packer(vocabulary), BLOCK).repartition(PARTITIONS, F.xxhash64("kind", "column", "y")))

    def part(kind: str, e: Examples, w: np.ndarray) -> np.ndarray:
        z = e.margins(w)
        if kind == "pair":  # fairness * (w . difference)^2 / 2
            return np.r_[fairness * e.back(z, n), fairness * (z @ z) / 2, 0.0]
        weight = np.where(e.y > 0, positive_weight, 1.0)
        loss = weight * np.logaddexp(0.0, np.where(e.y > 0, -z, z))
        return np.r_[e.back(weight * (sigmoid(z) - e.y), n), loss.sum(), len(e.y)]

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = sums(blocks, w, part, n + 2)
        seen, pull = max(1.0, total[-1]), np.r_[np.full(n - 1, ridge), 0.0]
        return total[n] / seen + pull @ (w * w) / 2, total[:n] / seen + pull * w

    return vocabulary, minimise(objective, n, rounds)


def _vocabulary(rows: DataFrame, most: int) -> dict[str, int]:
    """The features that tell the labels apart best, by the difference of their shares."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(batch["text"], batch["y"]):
                seen[y].update(features(word_set(text)))
            names = list(seen[0].keys() | seen[1].keys())
            counted = {"clean": [seen[0][k] for k in names], "toxic": [seen[1][k] for k in names]}
            yield pd.DataFrame({"name": pd.Series(names, dtype=object)} | {k: pd.Series(v, dtype="int64") for k, v in counted.items()})

    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    if not clean or not toxic:
        return {}
    counts = rows.mapInPandas(per_batch, "name string, clean long, toxic long").groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    spread = F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic)) + 1e-9
    strength = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / spread
    best = counts.filter(F.col("clean") + F.col("toxic") >= 3).orderBy(strength.desc(), "name").limit(most)
    return {r["name"]: k for k, r in enumerate(best.select("name").collect())}


def _packer(vocabulary: dict[str, int]):
    bias = len(vocabulary)

    def columns(words: set) -> set:
        return {vocabulary[f] for f in features(words) if f in vocabulary}

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, pairs = [], []
            for text in batch["text"]:
                words = word_set(text)
                mine = sorted(columns(words)) + [bias]
                rows.append((mine, [1.0] * len(mine)))
                if words & SWAP.keys():
                    pairs += filter(None, map(_difference, _SENTENCE.split(text.lower())))
            made = [block("row", rows, batch["y"].tolist())]
            if pairs:
                made.append(block("pair", pairs, [0.0] * len(pairs)))
            yield pd.DataFrame(made)

    def _difference(sentence: str) -> tuple[list, list] | None:
        words = set(_WORD.findall(sentence))
        if not words & SWAP.keys():
            return None
        here, there = columns(words), columns({SWAP.get(w, w) for w in words})
        out = [(c, 1.0) for c in sorted(here - there)] + [(c, -1.0) for c in sorted(there - here)]
        return ([c for c, _ in out], [v for _, v in out]) if out else None

    return per_batch


def score(docs: DataFrame, model: tuple[dict[str, int], np.ndarray]) -> DataFrame:
    """doc_id and score of every row of ``docs``; other columns but text are not read.

    The whole text counts, however long.  Null and empty texts get the score of a text without
    any feature; repeated rows stay separate rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0], np.asarray(model[1])))  # bounded by max_features

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, w = shared.value
        whole = {f: w[k] for f, k in vocabulary.items() if f[-1] != "_"}
        starts = {f[:-1]: w[k] for f, k in vocabulary.items() if f[-1] == "_"}
        for batch in batches:
            out = []
            for text in batch["text"]:
                z = w[-1]
                words = word_set(text)
                z += math.fsum(whole[x] for x in words & whole.keys())
                seen = {x[:n] for n in _STARTS for x in words if len(x) > n}
                z += math.fsum(starts[x] for x in seen & starts.keys())
                out.append(z)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": sigmoid(np.array(out, dtype=float))})

    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(per_batch, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
