"""Word counts over streams of text lines: per batch, and running totals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

BATCH_INTERVAL = "5 seconds"
#: different words whose counts a task holds before it hands them on
HELD_WORDS = 1 << 18
#: session settings that state with a time-to-live needs
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def file_lines(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """(value): lines of the text files that appear in a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """(value): lines sent by a server the user runs."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def split_words(lines: DataFrame) -> DataFrame:
    """(word): split on single spaces, so a second space gives an empty word."""
    return lines.select(F.explode(F.split("value", " ")).alias("word"))


def word_counts(lines: DataFrame) -> DataFrame:
    """(word, num).  On a batch its counts; on a stream the totals since the start."""
    return split_words(lines).groupBy("word").agg(F.count(F.lit(1)).alias("num"))


def each_batch(lines: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Counts of every batch on its own, no state kept: ``sink(counts, batch_id)``."""
    return lines.writeStream.foreachBatch(lambda batch, batch_id: sink(word_counts(batch), batch_id))


def running_totals(lines: DataFrame, sink: Callable[[DataFrame, int], None], *, sort: bool = True) -> DataStreamWriter:
    """Totals since the start, given whole to ``sink`` after every batch, sorted by word.

    Words never expire.  Set ``checkpointLocation`` to go on after a restart.
    """
    def each(totals: DataFrame, batch_id: int) -> None:
        sink(totals.orderBy("word") if sort else totals, batch_id)

    return word_counts(lines).writeStream.outputMode("complete").foreachBatch(each)


def changed_totals(lines: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """As ``running_totals``, but each batch hands on only the words it touched."""
    return word_counts(lines).writeStream.outputMode("update").foreachBatch(sink)


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last values of each key from a folder of changed rows, one sub-folder a batch (``batch_id``).

    A batch that is run again replaces its own folder, so a replay changes nothing; what a batch writes is in
    proportion to the keys it touched, not to all keys.
    """
    values = [c for c in written.columns if c not in (*keys, "batch_id")]
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def keyed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for the changed rows of each batch, read back by ``latest``."""
    return lambda changed, batch_id: changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def compact(written: DataFrame, keys: list[str], path: str) -> None:
    """Write the last values of each key as one batch, that of the last one seen, to a new folder ``path``."""
    last = written.agg(F.max("batch_id")).first()[0]
    if last is not None:
        latest(written, keys).write.parquet(f"{path}/batch_id={last}")


def fold_with_state(lines: DataFrame, fold: Callable[[list[int], int | None], int], *, ttl_ms: int | None = None) -> DataFrame:
    """(word, num): as ``fold_counts``, on keyed state with a native time-to-live.

    Needs the RocksDB state store (``ROCKSDB``), which keeps state on disk and not in the heap.  With
    ``ttl_ms`` a word's total is forgotten that long after it was last written, whether or not the word comes
    again; its state is then read and written by calls for each word.  Without, nothing is ever forgotten, and
    the totals go to the fold together with the new values, many words at a time.
    """
    if not ttl_ms:
        return fold_counts(lines, fold)

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.total = handle.getValueState("total", "num long", ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = [int(n) for pdf in rows for n in pdf["n"]]
            last = self.total.get()
            total = fold(new, last[0] if last is not None else None)
            self.total.update((total,))
            yield pd.DataFrame({"word": [key[0]], "num": [total]})

        def close(self) -> None:
            pass

    parts = split_words(lines).mapInPandas(_partial_counts, "word string, n long")
    return parts.groupBy("word").transformWithStateInPandas(Fold(), "word string, num long", "Update", "ProcessingTime")


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task's words, given out whenever ``HELD_WORDS`` different ones have come together."""
    held: Counter[str] = Counter()

    def given() -> Iterator[pd.DataFrame]:
        words = list(held)
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            yield pd.DataFrame({"word": part, "n": [held[w] for w in part]})
        held.clear()

    for batch in batches:
        held.update(batch["word"].tolist())
        if len(held) >= HELD_WORDS:
            yield from given()
    yield from given()


def fold_counts(
    lines: DataFrame,
    fold: Callable[[list[int], int | None], int],
    *,
    expire_after_ms: int | None = None,
) -> DataFrame:
    """(word, num) with a user function as state update: ``fold(new_values, last) -> state``.

    Each task first counts the words of its own rows, so a frequent word sends a few
    partial counts and not every occurrence.  ``expire_after_ms`` drops words not seen for
    that long; by default they stay for good.
    """
    def update(key, values, state):
        word = key[0]
        if state.hasTimedOut:
            state.remove()
            return
        new = [n for pdf in values for n in pdf["n"].tolist()]
        total = fold(new, state.get[0] if state.exists else None)
        state.update((total,))
        if expire_after_ms is not None:
            state.setTimeoutDuration(expire_after_ms)
        yield pd.DataFrame({"word": [word], "num": [total]})

    timeout = "NoTimeout" if expire_after_ms is None else "ProcessingTimeTimeout"
    parts = split_words(lines).mapInPandas(_partial_counts, "word string, n long")
    return parts.groupBy("word").applyInPandasWithState(update, "word string, num long", "num long", "update", timeout)


def to_console(counts: DataFrame, *, mode: str = "complete", interval: str = BATCH_INTERVAL) -> DataStreamWriter:
    """Print each result of a streaming table, a batch every ``interval``."""
    return counts.writeStream.outputMode(mode).format("console").trigger(processingTime=interval)
