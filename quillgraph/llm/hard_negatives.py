"""Hard negatives of anchor vectors, by exact search in a GNAT-style multiway hyperplane tree.

Scores are inner products.  Every row gets one more component, which brings all rows to the same length;
then a larger score is a smaller Euclidean distance, and a window of scores is an annulus around the
anchor.  Split points, far apart from each other, are chosen from a bounded sample; a row belongs to the
subtree of its nearest split point, level by level.  Each split point stores, for every sibling subtree,
the range of its distances to all rows in there (Brin, 1995).  By the triangle inequality a subtree can
hold rows of an annulus only if, for every split point, its range meets the annulus around the anchor
widened by their distance.  What is left is compared exactly.

The upper levels are known to all tasks.  Rows of a leaf are dealt to blocks of bounded size, anchors to
groups of bounded size; a task gets one block and one group, and splits its block once more the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import in_sample
from quillgraph.session import durable

FANOUT = 32
LEAF_ROWS = 2048
BLOCK_ROWS = 4096
JOBS = 1024
#: of the largest length: more than rounding can move a distance
SLACK = 1e-6
_STEP = 64


def usable(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _matrix(vectors, width: int) -> np.ndarray:
    """Shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes their length ``top``."""
    return np.c_[x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(axis=1)))]


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(0.0, square))


@dataclass
class Node:
    """Split points with the ranges of their distances to the rows of each child (low[i, j], high[i, j])."""

    points: np.ndarray
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        m = len(self.points)
        self.low, self.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The child of each row; ranges are widened to hold it."""
        d = _distances(x, self.points)
        child = d.argmin(axis=1)
        for j in np.unique(child):
            mine = d[child == j]
            self.low[:, j] = np.minimum(self.low[:, j], mine.min(axis=0))
            self.high[:, j] = np.maximum(self.high[:, j], mine.max(axis=0))
        return child

    def reach(self, x: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> np.ndarray:
        """(query, child): whether rows between ``near`` and ``far`` from the query can be in the child."""
        d = _distances(x, self.points)
        least = np.maximum(d - far[:, None], near[:, None] - d) - slack
        most = d + far[:, None] + slack
        open_ = np.zeros(d.shape, dtype=bool)
        for k in range(0, len(d), _STEP):  # bounded: _STEP x FANOUT x FANOUT
            s = slice(k, k + _STEP)
            open_[s] = ((self.high >= least[s][:, :, None]) & (self.low <= most[s][:, :, None])).all(axis=1)
        return open_


def far_points(sample: np.ndarray, m: int) -> np.ndarray:
    """``m`` of the first ``3 m`` rows, each as far as can be from those before."""
    some = np.unique(sample[: 3 * m], axis=0)
    chosen, away = [0], _distances(some, some[:1])[:, 0]
    while len(chosen) < min(m, len(some)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


class Tree:
    """One or two levels of nodes; leaves are numbered ``first * FANOUT + second``."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        two = leaves > FANOUT
        m = min(FANOUT, max(2, round(leaves**0.5) if two else leaves))
        self.root = Node(far_points(sample, m))
        child = _distances(sample, self.root.points).argmin(axis=1)
        self.below = [Node(far_points(sample[child == j], m)) for j in range(len(self.root.points))] if two else []

    def place(self, x: np.ndarray) -> np.ndarray:
        leaf = self.root.place(x) * FANOUT
        for j, node in enumerate(self.below):
            if (mine := leaf == j * FANOUT).any():
                leaf[mine] += node.place(x[mine])
        return leaf

    def ranges(self) -> pd.DataFrame:
        parts = []
        for number, node in enumerate([self.root, *self.below]):
            i, j = np.nonzero(np.isfinite(node.low))
            parts.append(pd.DataFrame({"node": number, "i": i, "j": j, "low": node.low[i, j], "high": node.high[i, j]}))
        return pd.concat(parts)

    def set_ranges(self, table: pd.DataFrame) -> None:
        for number, node in enumerate([self.root, *self.below]):
            t = table[table["node"] == number]
            i, j = t["i"].to_numpy(dtype=int), t["j"].to_numpy(dtype=int)
            node.low[i, j], node.high[i, j] = t["low"], t["high"]

    def leaves(self, x: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that may find rows in it)."""
        open_ = self.root.reach(x, near, far, slack)
        for j in range(open_.shape[1]):
            mine = np.flatnonzero(open_[:, j])
            if not len(mine):
                continue
            if not self.below:
                yield j * FANOUT, mine
                continue
            inner = self.below[j].reach(x[mine], near[mine], far[mine], slack)
            for k in range(inner.shape[1]):
                if inner[:, k].any():
                    yield j * FANOUT + k, mine[inner[:, k]]


class _Radii:
    def __init__(self, top: float) -> None:
        self.top = top

    def __call__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of rows with a score between ``low`` and ``high``."""
        base = (x * x).sum(axis=1) + self.top * self.top
        return np.sqrt(np.maximum(0.0, base - 2 * high)), np.sqrt(np.maximum(0.0, base - 2 * low))


@dataclass
class Index:
    """The rows, each with its leaf, and what all tasks know of them."""

    rows: DataFrame
    sizes: DataFrame
    tree: Tree
    width: int
    top: float
    sample: pd.DataFrame


def index(rows: DataFrame, *, max_sample: int = 8192) -> Index | None:
    """The tree over all ``rows`` (vec_id, label, vector); none if there are no rows.

    Split points come from a hash sample of about ``max_sample`` rows, which also gives first bounds of the
    scores sought.  Every row is placed, and the ranges are over every row.
    """
    rows = durable(rows)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(square)).first()
    if not n:
        return None
    width, top = max(1, width), float(most) ** 0.5
    sample = rows.filter(in_sample(rows, max_sample, "vec_id")).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").toPandas()
    if sample.empty:  # the hash range can miss a small table
        sample = rows.orderBy("vec_id").limit(1).toPandas()
    tree = Tree(_lifted(_matrix(sample["vector"], width), top), min(FANOUT * FANOUT, -(-n // LEAF_ROWS)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=tree.place(_lifted(_matrix(batch["vector"], width), top)))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tree.place(_lifted(_matrix(batch["vector"], width), top))
        yield tree.ranges()

    placed = durable(rows.mapInPandas(place, "vec_id long, label long, vector array<double>, leaf int"))
    found = placed.select("vector").mapInPandas(ranges, "node int, i int, j int, low double, high double")
    tree.set_ranges(found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas())  # at most (FANOUT + 1) FANOUT^2 rows
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    return Index(placed, durable(sizes), tree, width, top, sample)


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores, the places of the ``k`` largest allowed ones; of equal ones the first."""
    out = []
    for s, ok in zip(scores, allowed):
        at = np.flatnonzero(ok)
        if len(at) > k:
            v = s[at]
            edge = np.partition(v, len(v) - k)[len(v) - k]
            above, level = at[v > edge], at[v == edge]
            at = np.r_[above, level[: k - len(above)]]
        out.append(at)
    return out


def search(idx: Index, jobs: DataFrame, k: int, *, same: bool) -> DataFrame:
    """(job, vec_id, score, rank): for each job its first ``k`` rows by score, ties by vec_id.

    ``jobs`` are (job, own, label, vector, low, high): rows of the same label (or, without ``same``, of
    another one), other than the row ``own``, with low <= score <= high.
    """
    tree, width, slack, radii = idx.tree, idx.width, SLACK * max(1.0, idx.top), _Radii(idx.top)
    sent = jobs.sparkSession.sparkContext.broadcast((idx.sample["vec_id"].to_numpy(), idx.sample["label"].to_numpy(), _matrix(idx.sample["vector"], width)))  # max_sample rows

    def allowed(score, ids, labels, own, label, low, high) -> np.ndarray:
        fits = labels[None, :] == label[:, None]
        return (fits if same else ~fits) & (ids[None, :] != own[:, None]) & (score >= low[:, None]) & (score <= high[:, None])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, seen = sent.value
        for batch in batches:
            for at in range(0, len(batch), _STEP):
                some = batch.iloc[at : at + _STEP]
                x, low, high = _matrix(some["vector"], width), some["low"].to_numpy().copy(), some["high"].to_numpy()
                score = x @ seen.T
                ok = allowed(score, ids, labels, some["own"].to_numpy(), some["label"].to_numpy(), low, high)
                for r, found in enumerate(_first(score, ok, k)):
                    if len(found) == k:  # the k-th best is at least as good as the k-th best of the sample
                        low[r] = score[r, found].min()
                near, far = radii(x, low, high)
                for leaf, mine in tree.leaves(np.c_[x, np.zeros(len(x))], near, far, slack):
                    yield some.iloc[mine].assign(leaf=leaf, low=low[mine])

    schema = "job long, own long, label long, vector array<double>, low double, high double, leaf int"
    visits = durable(jobs.mapInPandas(route, schema))
    load = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / JOBS).cast("int").alias("parts"))
    deal = durable(idx.sizes.join(load, "leaf"))  # at most FANOUT^2 rows
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = idx.rows.join(F.broadcast(deal), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), "blocks").cast("int"))
    rows = rows.withColumn("part", upto("parts")).select("leaf", "block", "part", "vec_id", "label", "vector")
    asked = visits.join(F.broadcast(deal), "leaf").withColumn("part", F.pmod(F.xxhash64("job"), "parts").cast("int"))
    asked = asked.withColumn("block", upto("blocks")).select("leaf", "block", "part", "job", "own", "label", "vector", "low", "high")

    def compare(some: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """Both sides are bounded: about BLOCK_ROWS rows and JOBS jobs."""
        some = some.sort_values("vec_id", kind="stable")
        x, ids, labels = _matrix(some["vector"], width), some["vec_id"].to_numpy(), some["label"].to_numpy()
        q, low, high = _matrix(ask["vector"], width), ask["low"].to_numpy(), ask["high"].to_numpy()
        own, label, job = ask["own"].to_numpy(), ask["label"].to_numpy(), ask["job"].to_numpy()
        lifted = _lifted(x, radii.top)
        node = Node(far_points(lifted, FANOUT))
        child = node.place(lifted)
        open_ = node.reach(np.c_[q, np.zeros(len(q))], *radii(q, low, high), slack)
        best = [np.zeros(0, int)] * len(q), [np.zeros(0)] * len(q)
        for j in range(len(node.points)):
            here, mine = np.flatnonzero(child == j), np.flatnonzero(open_[:, j])
            if not len(here) or not len(mine):
                continue
            score = q[mine] @ x[here].T
            ok = allowed(score, ids[here], labels[here], own[mine], label[mine], low[mine], high[mine])
            for r, found in enumerate(_first(score, ok, k)):
                if len(found):
                    best[0][mine[r]] = np.r_[best[0][mine[r]], here[found]]
                    best[1][mine[r]] = np.r_[best[1][mine[r]], score[r, found]]
        out = []
        for r, (at, score) in enumerate(zip(*best)):
            first = np.lexsort((at, -score))[:k]
            out.append(pd.DataFrame({"job": job[r], "vec_id": ids[at[first]], "score": score[first]}))
        return pd.concat(out)

    keys = ["leaf", "block", "part"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_both(compare), "job long, vec_id long, score double")
    order = W.partitionBy("job").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _both(compare):
    empty = pd.DataFrame({"job": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return lambda rows, asked: compare(rows, asked) if len(rows) and len(asked) else empty


def mine(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` are (vec_id, label, vector).  The rows where ``anchors`` holds are anchors; an anchor's
    positives are its first ``positives`` other rows of the same label by inner product, and for each of
    them its hard negatives are the first ``negatives`` rows of another label with a score of ``low`` to
    ``high`` percent of the positive's (none if that is below 0).  Ties go to the smaller vec_id.

    Rows without an id or a label, and rows whose vector is null or holds null or non-finite components,
    take no part.  Equal rows count once; rows of one id are never positives of each other.  Shorter
    vectors are filled with zeros.  Scores are exact while sums of products stay below 2^53.  Other
    columns are not read; an empty table gives an empty table.
    """
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    known = known.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).dropDuplicates()
    idx = index(known)
    if idx is None:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"
        return known.sparkSession.createDataFrame([], schema)
    asked = idx.rows.filter(anchors).select("vec_id", "label", "vector")
    asked = durable(asked.withColumn("job", F.monotonically_increasing_id()))
    wide = [F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")]
    first = search(idx, asked.select("job", F.col("vec_id").alias("own"), "label", "vector", *wide), positives, same=True)
    pairs = durable(first.select("job", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    pairs = pairs.join(asked, "job").withColumn("job", F.col("job") * (positives + 1) + F.col("rank"))
    edges = [(F.col("positive_score") * share / 100).alias(name) for name, share in (("low", low), ("high", high))]
    windows = durable(pairs.select("job", F.col("vec_id").alias("own"), "label", "vector", *edges, "positive_id", "positive_score"))
    found = search(idx, windows.select("job", "own", "label", "vector", "low", "high").filter("low <= high"), negatives, same=False)
    named = found.join(windows.select("job", "own", "positive_id", "positive_score"), "job")
    return named.select(F.col("own").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
