"""Hooks for functions of the user's own: aggregates with partial and merge steps, and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import durable

#: states merged in one call, about
FAN_IN = 64


def user_aggregate(
    rows: DataFrame,
    keys: Sequence[str],
    state: str,
    partial: Callable[[pd.DataFrame], dict],
    merge: Callable[[pd.DataFrame], dict],
    *,
    fan_in: int | None = None,
) -> DataFrame:
    """(keys, state columns): an aggregate whose steps are Python functions.

    ``partial`` makes a state (a dict of the columns of the DDL ``state``) of some rows of one key, ``merge``
    one of several states; both get a pandas frame without the keys, in no order.  Tasks make a state for
    each key of a batch, then states are merged in rounds of about ``fan_in`` at a time, so a key with most
    of the rows never is one Python group.  Null is a key like any other; no rows give no states.
    """
    fan_in = fan_in or FAN_IN
    keyed = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def made(group: pd.DataFrame, make: Callable[[pd.DataFrame], dict]) -> pd.DataFrame:
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in names}, **make(group.drop(columns=names))}])

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, group in batch.groupby(names, dropna=False, sort=False):
                yield made(group, partial)

    states = durable(rows.mapInPandas(per_batch, f"{keyed}, {state}").withColumn("_n", F.monotonically_increasing_id()))
    most = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > fan_in:
        groups = -(-most // fan_in)
        merged = states.withColumn("_part", F.pmod(F.xxhash64("_n"), F.lit(groups))).groupBy(*keys, "_part")
        merged = merged.applyInPandas(lambda group: made(group.drop(columns=["_n", "_part"]), merge), f"{keyed}, {state}")
        states, most = durable(merged.withColumn("_n", F.monotonically_increasing_id())), groups
    return states.groupBy(*keys).applyInPandas(lambda group: made(group.drop(columns="_n"), merge), f"{keyed}, {state}")


def table_function(
    rows: DataFrame, handler: type, returns: str, *, keys: Sequence[str], order: Sequence[str] = (), batches: bool = False
) -> DataFrame:
    """The rows that ``handler`` makes of each partition of ``rows`` by ``keys``, read in ``order``.

    ``handler`` is a class with ``eval(row)`` and ``terminate()``, both generators of tuples (``returns`` is
    their DDL); every partition gets an object of its own.  Rows reach Python as Arrow batches, and a partition
    is streamed through, not held, so the handler decides what it keeps.

    With ``batches``, ``eval`` takes an Arrow batch and both give Arrow tables: no Python object is made for a row
    or a key.  An object then sees the partitions of a task one after the other, each key's rows together and in
    order; without ``keys`` it sees the rows as they lie, and none is shuffled.
    """
    if batches:
        dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else rows
        return F.arrow_udtf(handler, returnType=returns)(dealt.asTable())
    table = rows.asTable().partitionBy(*keys)
    return F.udtf(handler, returnType=returns, useArrow=True)(table.orderBy(*order) if order else table)


class Moments:
    """Count, mean and squared deviations of a column ``x``: states that merge without losing digits."""

    STATE = "n long, mean double, m2 double"

    @staticmethod
    def partial(rows: pd.DataFrame) -> dict:
        x = rows["x"].dropna().astype(float)
        mean = float(x.mean()) if len(x) else 0.0
        return {"n": len(x), "mean": mean, "m2": float(((x - mean) ** 2).sum())}

    @staticmethod
    def merge(states: pd.DataFrame) -> dict:
        n = int(states["n"].sum())
        mean = float((states["n"] * states["mean"]).sum()) / max(1, n)
        return {"n": n, "mean": mean, "m2": float((states["m2"] + states["n"] * (states["mean"] - mean) ** 2).sum())}


class PhraseWalk:
    """Runs of kept words of each text as a walk over its words in order: (doc, phrase, start, noun).

    Takes Arrow batches (doc, num, raw, pos, kept).  A run can go on in the next batch; only that run is held.
    """

    def __init__(self) -> None:
        self.last, self.words, self.start, self.noun = None, [], None, False

    def _run(self) -> list[list[pa.Array]]:
        """The held run as one row, if there is one."""
        if not self.words:
            return []
        phrase = " ".join(word for part in self.words for word in part.to_pylist())
        made = [self.last[0], pa.array([phrase], pa.string()), self.start, pa.array([self.noun])]
        self.words, self.noun = [], False
        return [made]

    def _hold(self, raw: pa.Array, noun: np.ndarray) -> None:
        self.words.append(raw)
        self.noun = self.noun or bool(noun.any())

    def eval(self, batch: pa.RecordBatch):
        doc, num, raw, pos, kept = batch.columns
        if not len(doc):
            return
        before = pa.concat_arrays([doc[:1], doc]) if self.last is None else pa.concat_arrays([self.last[0], doc])
        number = num.to_numpy(zero_copy_only=False).astype(np.int64)
        previous = np.concatenate(([number[0] if self.last is None else self.last[1]], number[:-1]))
        code = before.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        kept = kept.to_numpy(zero_copy_only=False).astype(bool)
        noun = pc.starts_with(pos, "N").to_numpy(zero_copy_only=False).astype(bool)
        # a word goes on with the run before it, or a run ends before it
        goes_on = kept & np.concatenate(([bool(self.words)], kept[:-1])) & (code[1:] == code[:-1]) & (number == previous + 1)
        breaks = np.append(np.flatnonzero(~goes_on), len(kept))
        made = []
        if self.words:
            self._hold(raw[: breaks[0]], noun[: breaks[0]])
            if breaks[0] < len(kept):
                made = self._run()
        starts = np.flatnonzero(kept & ~goes_on)
        ends = breaks[np.searchsorted(breaks, starts, side="right")]
        self.last = (doc[-1:], int(number[-1]))
        if len(starts) and ends[-1] == len(kept):
            self.start = num[starts[-1] : starts[-1] + 1]
            self._hold(raw[starts[-1] :], noun[starts[-1] :])
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            at = np.concatenate(([0], np.cumsum(ends - starts)))
            inside = np.repeat(starts - at[:-1], ends - starts) + np.arange(at[-1])
            words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), raw.take(pa.array(inside)).cast(pa.string()))
            first = pa.array(starts)
            made.append([doc.take(first), pc.binary_join(words, " "), num.take(first), pa.array(np.logical_or.reduceat(noun[inside], at[:-1]))])
        yield from self._table(made)

    def terminate(self):
        yield from self._table(self._run())

    @staticmethod
    def _table(made: list[list[pa.Array]]):
        if made:
            yield pa.table([pa.concat_arrays(parts) for parts in zip(*made)], names=["doc", "phrase", "start", "noun"])
