"""Linear models over sparse features, trained by full-batch rounds on Spark.

Examples are packed once into blocks; a round sends the weights out, each task adds up its
blocks' gradients, and the sums (one vector a partition) come back.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = "kind string, column binary, value binary, start binary, y binary"
PARTITIONS = 8
#: examples are packed into no more partitions, so a round brings at most so many vectors to the driver
MAX_PARTITIONS = 1024


def block(kind: str, rows: list[tuple[list, list]], y: list) -> dict:
    """One packed block of examples given as (columns, values)."""
    return {
        "kind": kind,
        "column": np.array([c for cs, _ in rows for c in cs], dtype=np.int32).tobytes(),
        "value": np.array([v for _, vs in rows for v in vs], dtype=np.float64).tobytes(),
        "start": np.cumsum([0] + [len(cs) for cs, _ in rows]).astype(np.int64).tobytes(),
        "y": np.array(y, dtype=np.float64).tobytes(),
    }


class Examples:
    """A packed block read back."""

    def __init__(self, r) -> None:
        self.column, self.value = np.frombuffer(r.column, np.int32), np.frombuffer(r.value, np.float64)
        start = np.frombuffer(r.start, np.int64)
        self.y = np.frombuffer(r.y, np.float64)
        self.row = np.repeat(np.arange(len(self.y)), np.diff(start))

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], len(self.y))

    def back(self, per_row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.column, self.value * per_row[self.row], n)


def sums(blocks: DataFrame, w: np.ndarray, part: Callable[[str, Examples, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part(kind, examples, w)``, vectors of length ``size``, over all blocks."""

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for r in batch.itertuples(index=False):
                total += part(r.kind, Examples(r), w)
        yield pd.DataFrame({"total": [total.tolist()]})

    # bounded: at most MAX_PARTITIONS vectors of the length of the model; summed in a fixed order
    rows = blocks.mapInPandas(per_partition, "total array<double>").toPandas()["total"]
    return np.sum(np.sort(np.stack([np.asarray(x, dtype=float) for x in rows]), axis=0), axis=0) if len(rows) else np.zeros(size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def descent(size: int, rounds: int, memory: int = 10, tolerance: float = 1e-4) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS with step halving: yields points, is sent (value, gradient) there, returns the minimum.

    Stops after ``rounds`` points, or when no component of the gradient exceeds ``tolerance``.
    """
    w = np.zeros(size)
    value, gradient = yield w
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    calls = 1
    while calls < rounds and np.abs(gradient).max() > tolerance:
        direction, kept = gradient.copy(), []
        for s, y in reversed(steps):
            kept.append((s @ direction) / (s @ y))
            direction -= kept[-1] * y
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), k in zip(steps, reversed(kept)):
            direction += (k - (y @ direction) / (s @ y)) * s
        rate, slope = 1.0 if steps else min(1.0, 1.0 / np.abs(gradient).sum()), gradient @ direction
        while calls < rounds:
            after = w - rate * direction
            new_value, new_gradient = yield after
            calls += 1
            if new_value <= value - 1e-4 * rate * slope:
                break
            rate /= 3
        else:
            break
        if (s := after - w) @ (y := new_gradient - gradient) > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        w, value, gradient = after, new_value, new_gradient
    return w


def minimise_all(objectives: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], count: int, size: int, rounds: int) -> list[np.ndarray]:
    """``count`` minima at once: one call of ``objectives``, which takes a point for each, is one job."""
    walks = [descent(size, rounds) for _ in range(count)]
    points, going = [next(w) for w in walks], set(range(count))
    while going:
        found = objectives(points)
        for k in sorted(going):
            try:
                points[k] = walks[k].send(found[k])
            except StopIteration as end:
                points[k] = end.value
                going.discard(k)
    return points


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, rounds: int) -> np.ndarray:
    """The minimum of one objective; one call is one job."""
    return minimise_all(lambda points: [objective(points[0])], 1, size, rounds)[0]
