"""Streams over a folder of text files, restarted on their checkpoint."""

from collections import Counter

import pytest

from quillgraph.streaming import word_count as wc

FIRST, SECOND = "a b a", "b c  "
TOTAL = {"": 2, "a": 2, "b": 2, "c": 1}


def drop(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text + "\n")


def finish(writer, state):
    run = writer.option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert run.exception() is None


def test_batch_counts(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "1.txt", FIRST)
    drop(src, "2.txt", SECOND)
    seen = []
    lines = wc.file_lines(spark, str(src), files_per_batch=1)
    finish(wc.each_batch(lines, lambda counts, _: seen.append({r.word: r.num for r in counts.collect()})), tmp_path / "state")
    assert sorted(seen, key=str) == sorted([{"a": 2, "b": 1}, {"b": 1, "c": 1, "": 2}], key=str)


def test_running_totals_survive_a_restart(spark, tmp_path):
    src, state = tmp_path / "in", tmp_path / "state"
    seen = []
    for name, text in (("1.txt", FIRST), ("2.txt", SECOND)):
        drop(src, name, text)
        lines = wc.file_lines(spark, str(src))
        finish(wc.running_totals(lines, lambda totals, _: seen.append([(r.word, r.num) for r in totals.collect()])), state)
    assert seen[-1] == sorted(TOTAL.items())
    assert dict(seen[0]) == {"a": 2, "b": 1}


def test_changed_totals(spark, tmp_path):
    src, state = tmp_path / "in", tmp_path / "state"
    seen = []
    for name, text in (("1.txt", FIRST), ("2.txt", SECOND)):
        drop(src, name, text)
        finish(wc.changed_totals(wc.file_lines(spark, str(src)), lambda t, _: seen.append({r.word: r.num for r in t.collect()})), state)
    assert [s for s in seen if s][-1] == {"b": 2, "c": 1, "": 2}


def test_fold(spark, tmp_path):
    src, state = tmp_path / "in", tmp_path / "state"
    totals = {}
    for name, text in (("1.txt", FIRST), ("2.txt", SECOND)):
        drop(src, name, text)
        folded = wc.fold_counts(wc.file_lines(spark, str(src)), lambda new, last: max([*new, last or 0]))
        writer = folded.writeStream.outputMode("update").foreachBatch(lambda df, _: totals.update({r.word: r.num for r in df.collect()}))
        finish(writer, state)
    assert totals == {"a": 2, "b": 1, "c": 1, "": 2}  # the largest count of a batch


def test_word_counts_of_a_batch(spark):
    lines = spark.createDataFrame([(FIRST,), (SECOND,), ("",)], "value string")
    got = {r.word: r.num for r in wc.word_counts(lines).collect()}
    assert got == Counter(TOTAL) + Counter({"": 1})


def test_console_sink_is_configured(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "1.txt", FIRST)
    run = wc.to_console(wc.word_counts(wc.file_lines(spark, str(src)))).start()
    run.processAllAvailable()
    run.stop()
    assert run.exception() is None


@pytest.mark.parametrize("shape", ["file", "folder"])
def test_stream_queries_over_a_file_and_a_folder(spark, tmp_path, shape):
    from quillgraph.plans.catalog import QUERIES

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c\nd"), (3, None)], "doc_id long, text string")
    table = tmp_path / "documents.parquet"
    if shape == "folder":
        docs.repartition(3).write.parquet(str(table))
    else:
        docs.toPandas().to_parquet(table)
    for name in ("stream_word_counts", "stream_running_counts"):
        got = {r.word: r.num for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {"a": 2, "b": 2, "c": 1, "d": 1}


def test_every_batch_is_kept(spark, tmp_path):
    from quillgraph.plans.catalog import _finished

    for name, text in (("1.txt", FIRST), ("2.txt", SECOND)):
        drop(tmp_path / "in", name, text)
    found = _finished(spark, lambda sink: wc.each_batch(wc.file_lines(spark, str(tmp_path / "in"), files_per_batch=1), sink), whole=False)
    total = Counter()
    for r in found.collect():
        total[r.word] += r.num
    assert total == Counter(TOTAL)


def test_keyed_sink_holds_the_totals_after_two_batches_and_a_replay(spark, tmp_path):
    """Only changed words are written; the last value of each is the total, and a batch run again changes nothing."""
    src, state, out = tmp_path / "in", tmp_path / "state", str(tmp_path / "out")
    sink, batches = wc.keyed_sink(out), {}

    def keep(changed, batch_id):
        batches[batch_id] = changed.collect()
        sink(changed, batch_id)

    for name, text in (("1.txt", FIRST), ("2.txt", SECOND)):
        drop(src, name, text)
        finish(wc.changed_totals(wc.file_lines(spark, str(src)), keep), state)
    read = lambda folder: spark.read.schema("word string, num long").parquet(folder)
    totals = lambda folder: {r.word: r.num for r in wc.latest(read(folder), ["word"]).collect()}
    assert totals(out) == TOTAL
    written = [{r.word for r in rows} for _, rows in sorted(batches.items()) if rows]
    assert written == [{"a", "b"}, {"b", "c", ""}]
    for batch_id, rows in batches.items():
        if rows:
            sink(spark.createDataFrame(rows), batch_id)
    assert totals(out) == TOTAL
    wc.compact(read(out), ["word"], str(tmp_path / "small"))
    assert totals(str(tmp_path / "small")) == TOTAL and read(str(tmp_path / "small")).count() == len(TOTAL)


@pytest.fixture
def rocksdb(spark):
    before = {k: spark.conf.get(k, None) for k in wc.ROCKSDB}
    for k, v in wc.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(("ttl_ms", "after"), [(None, {"a": 2, "b": 1, "c": 1, "": 2}), (600_000, {"a": 2, "b": 1, "c": 1, "": 2}), (1, {"a": 2, "b": 1, "c": 1, "": 2})])
def test_fold_with_state(spark, tmp_path, rocksdb, ttl_ms, after):
    """The largest count of a batch, over a restart; and sums, which an expired state forgets."""
    src, seen, sums = tmp_path / "in", {}, {}
    for name, text in (("1.txt", FIRST), ("2.txt", SECOND)):
        drop(src, name, text)
        for fold, found, state in ((lambda new, last: max([*new, last or 0]), seen, "a"), (lambda new, last: sum(new) + (last or 0), sums, "b")):
            folded = wc.fold_with_state(wc.file_lines(spark, str(src)), fold, ttl_ms=ttl_ms)
            writer = folded.writeStream.outputMode("update").foreachBatch(lambda df, _, to=found: to.update({r.word: r.num for r in df.collect()}))
            finish(writer, tmp_path / f"state-{state}")
    assert seen == after
    assert sums == {"a": 2, "b": 1 if ttl_ms == 1 else 2, "c": 1, "": 2}
