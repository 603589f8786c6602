"""Quality scores by positive-unlabelled learning.

Trusted positives and all texts, whose labels are not looked at, train an additive
logistic model by the non-negative unbiased risk (Kiryo et al., 2017):
``prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)])``.  The class prior is
estimated from the two alone by the best-bin ratio of their score distributions (Garg et al.,
2021), each half of the texts scored by a model of the other half.  Texts enter as counts of
their distinct step vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import labelled_sample
from quillgraph.llm.linear import BLOCK, MAX_PARTITIONS, PARTITIONS, Examples, block, minimise, minimise_all, sigmoid, sums
from quillgraph.session import durable

STEPS = 24
STATISTICS = 16
SIZE = STATISTICS * STEPS + 1
SCORE_BINS = 400
PARTITION_ROWS = 1 << 17
BLOCK_ROWS = 4096
_PIECE = 1 << 20


def statistics(text: str) -> list[float]:
    """Shares between 0 and 1 that describe the whole text; all 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    seen = np.zeros(256, dtype=np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    for k in range(0, len(raw), _PIECE):
        seen += np.bincount(raw[k : k + _PIECE], minlength=256)
    n, visible = len(words), max(1, int(seen.sum() - seen[9:14].sum() - seen[32]))
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    stops, marks = seen[[46, 44, 59, 58]].sum(), seen[[33, 63]].sum()
    symbols = seen[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
    other = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum() - stops - marks - symbols
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    different = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    shares = [
        upper / visible,
        digits / visible,
        stops / visible * 4,
        marks / visible * 4,
        symbols / visible * 2,
        other / visible * 4,
        seen[128:].sum() / visible,
        lower / visible,
        different / n,
        same / n,
        pairs / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
        np.log2(n + 1) / 20,
        np.log2(visible / n + 1) / 8,
        np.log2(n / max(1, len(lines)) + 1) / 16,
        max(map(len, words)) / (max(map(len, words)) + 30),
    ]
    return [float(min(1.0, max(0.0, x))) for x in shares]


def steps(text: str) -> list[int]:
    """The step of each statistic, finer near 0."""
    return [min(STEPS - 1, int(STEPS * x**0.5)) for x in statistics(text)]


def columns(text: str) -> list[int]:
    """The step of each statistic as a column number; the last is the intercept."""
    return [k * STEPS + x for k, x in enumerate(steps(text))] + [SIZE - 1]


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = pd.DataFrame({"kind": "unl" + batch["half"], "vector": [bytes(steps(t)) for t in batch["text"]]})
        trusted = made[batch["trusted"]]
        yield pd.concat([made, trusted.assign(kind="pos" + trusted["kind"].str[3:])])


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of distinct vectors; ``y`` of an example is the number of texts that have it."""
    first = np.arange(STATISTICS) * STEPS
    for batch in batches:
        for kind, part in batch.groupby("kind", sort=True):
            for k in range(0, len(part), BLOCK_ROWS):
                some = part.iloc[k : k + BLOCK_ROWS]
                rows = [((c := [*(first + np.frombuffer(v, np.uint8)), SIZE - 1]), [1.0] * len(c)) for v in some["vector"]]
                yield pd.DataFrame([block(kind, rows, some["n"])])


def packed(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """Blocks of all rows of ``docs`` (kinds unl0, unl1) and of those with an id in ``positives`` (pos0, pos1).

    ``positives`` is a bounded sample of distinct ids, so it is broadcast.  The distinct vectors, far fewer
    than the texts, decide the number of partitions.
    """
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = marked.join(F.broadcast(positives.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left")
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("string")
    rows = marked.select("text", half.alias("half"), F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = durable(rows.mapInPandas(_vectors, "kind string, vector binary").groupBy("kind", "vector").agg(F.count(F.lit(1)).alias("n")))
    partitions = min(MAX_PARTITIONS, max(PARTITIONS, -(-counts.count() // PARTITION_ROWS)))
    merged = counts.coalesce(partitions).sortWithinPartitions("kind", "vector")
    return durable(merged.mapInPandas(_pack, BLOCK))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    *,
    max_positives: int = 20_000,
    ridge: float = 1e-3,
    rounds: int = 60,
    prior_slack: float = 0.01,
) -> np.ndarray:
    """Weights with the intercept last.

    All rows of ``docs`` are the unlabelled side, and at most about ``max_positives`` documents
    labelled 1 (where ``usable`` holds), a hash sample, the trusted one.  Without a trusted
    positive the weights are 0 (score 0.5).  At most ``prior_slack`` is taken off the estimated prior.
    """
    positives = labelled_sample(labels, "quality", max_positives, _and(F.col("quality") == 1, usable))
    if positives.isEmpty():
        return np.zeros(SIZE)
    blocks = packed(docs, positives)
    halves = minimise_all(lambda points: _contrast(blocks, points, ridge), 2, SIZE, rounds)
    prior = estimate_prior(blocks, *halves, prior_slack)
    return minimise(lambda w: _risk(blocks, w, prior, ridge), SIZE, rounds)


def _and(a: Column, b: Column | None) -> Column:
    return a if b is None else a & b


def _ridge(w: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    pull = np.r_[np.full(SIZE - 1, ridge), 0.0]
    return pull @ (w * w) / 2, pull * w


def _side(kind: str, own: np.ndarray) -> np.ndarray:
    """The sums of one block in the half of the vector that belongs to its sample."""
    none = np.zeros_like(own)
    return np.r_[own, none] if kind.startswith("pos") else np.r_[none, own]


def _contrast(blocks: DataFrame, points: list[np.ndarray], ridge: float) -> list[tuple[float, np.ndarray]]:
    """For each half, value and gradient of telling positives from unlabelled ones there, both weighing the same."""
    width = 2 * (SIZE + 2)

    def part(kind: str, e: Examples, w: np.ndarray) -> np.ndarray:
        z, y = e.margins(w[SIZE:] if kind.endswith("1") else w[:SIZE]), float(kind.startswith("pos"))
        own = _side(kind, np.r_[e.back(e.y * (sigmoid(z) - y), SIZE), e.y @ np.logaddexp(0.0, -z if y else z), e.y.sum()])
        return np.r_[np.zeros(width), own] if kind.endswith("1") else np.r_[own, np.zeros(width)]

    total = sums(blocks, np.concatenate(points), part, 2 * width)
    out = []
    for w, half in zip(points, (total[:width], total[width:])):
        value, gradient = _ridge(w, ridge)
        for side in (half[: SIZE + 2], half[SIZE + 2 :]):
            value, gradient = value + side[SIZE] / max(1.0, side[-1]) / 2, gradient + side[:SIZE] / max(1.0, side[-1]) / 2
        out.append((value, gradient))
    return out


def estimate_prior(blocks: DataFrame, w0: np.ndarray, w1: np.ndarray, slack: float = 0.01) -> float:
    """The least ratio, over score thresholds, of the unlabelled share above to the positive share above.

    The mean over the halves of all texts, each scored by the weights of the other half, which
    have not seen it.  Both shares carry a deviation bound, so a threshold with few rows above
    does not decide.  Two standard errors, ``slack`` at most, are taken off: with a prior that is too
    high the risk is least if everything is accepted, one a little low costs little.
    """
    width = 2 * SCORE_BINS

    def part(kind: str, e: Examples, w: np.ndarray) -> np.ndarray:
        step = np.minimum(SCORE_BINS - 1, (sigmoid(e.margins(w[SIZE:] if kind.endswith("0") else w[:SIZE])) * SCORE_BINS).astype(int))
        own, none = _side(kind, np.bincount(step, e.y, SCORE_BINS)), np.zeros(width)
        return np.r_[own, none] if kind.endswith("0") else np.r_[none, own]

    total = sums(blocks, np.r_[w0, w1], part, 2 * width)
    prior = np.mean([_best_bin(x[:SCORE_BINS], x[SCORE_BINS:]) for x in (total[:width], total[width:])])
    n_unl = max(1.0, (total[SCORE_BINS:width].sum() + total[width + SCORE_BINS :].sum()) / 2)
    return float(np.clip(prior - min(slack, 2 * np.sqrt(prior * (1 - prior) / n_unl)), 0.001, 0.995))


def _best_bin(pos: np.ndarray, unl: np.ndarray) -> float:
    n_pos, n_unl = max(1.0, pos.sum()), max(1.0, unl.sum())
    q_pos, q_unl = np.cumsum(pos[::-1]) / n_pos, np.cumsum(unl[::-1]) / n_unl
    slack = np.sqrt(np.log(20.0) / (2 * n_pos)) + np.sqrt(np.log(20.0) / (2 * n_unl))
    above = np.flatnonzero(q_pos > 0.1)
    if not len(above):
        return 0.5
    best = above[int(((q_unl[above] + slack) / q_pos[above]).argmin())]
    return min(1.0, q_unl[best] / q_pos[best])


def _risk(blocks: DataFrame, w: np.ndarray, prior: float, ridge: float) -> tuple[float, np.ndarray]:
    """Value and gradient of the non-negative risk at ``w`` (logistic loss), over both halves."""

    def part(kind: str, e: Examples, w: np.ndarray) -> np.ndarray:
        z = e.margins(w)
        p, n = sigmoid(z), e.y
        return _side(kind, np.r_[e.back(n * (p - 1), SIZE), e.back(n * p, SIZE), n @ np.logaddexp(0.0, -z), n @ np.logaddexp(0.0, z), n.sum()])

    width = 2 * SIZE + 3
    total = sums(blocks, w, part, 2 * width)
    pos, unl = total[:width] / max(1.0, total[width - 1]), total[width:] / max(1.0, total[-1])
    value, gradient = _ridge(w, ridge)
    value, gradient = value + prior * pos[-3], gradient + prior * pos[:SIZE]
    negative = unl[-2] - prior * pos[-2]
    if negative > 0:
        value, gradient = value + negative, gradient + unl[SIZE : 2 * SIZE] - prior * pos[SIZE : 2 * SIZE]
    return value, gradient


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs``; other columns but text are not read."""
    return scored(docs.select(F.col("doc_id"), "text"), w).select(F.col("doc_id").cast("long").alias("doc_id"), "score")


def scored(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """``docs`` with ``score`` (replaced if there), from the whole text.

    Null and empty texts get the score of a text without words; repeated rows stay rows of
    their own; an empty table gives an empty table.
    """
    weights = np.asarray(w)

    @F.pandas_udf("double")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(np.array([weights[columns(t)].sum() for t in texts], dtype=float)))

    return docs.withColumn("score", of_text(F.coalesce("text", F.lit(""))))
