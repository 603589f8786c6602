"""User aggregates and table functions against built-in forms."""

import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import text as tt
from quillgraph.operators import textrank as tr
from quillgraph.operators import user_functions as uf


def test_moments_with_a_group_of_half_the_rows(spark):
    rng = random.Random(1)
    data = [("hot" if k % 2 else rng.choice(["a", "b", None]), rng.gauss(1e6, 3)) for k in range(3000)] + [("none", None), ("one", 5.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        rows = spark.createDataFrame(data, "kind string, x double").repartition(4)
        got = {r["kind"]: r for r in uf.user_aggregate(rows, ["kind"], uf.Moments.STATE, uf.Moments.partial, uf.Moments.merge, fan_in=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {k for k, _ in data}
    for kind, r in got.items():
        x = [v for k, v in data if k == kind and v is not None]
        assert r["n"] == len(x)
        if x:
            assert r["mean"] == pytest.approx(statistics.fmean(x)) and r["m2"] == pytest.approx(statistics.pvariance(x) * len(x), rel=1e-6, abs=1e-9)


def test_no_merge_sees_more_than_its_share(spark, tmp_path):
    """400 batches of one key, merged about 8 at a time: no Python group holds the key's rows or all its states."""

    def seen(states):
        return {"n": int(states["n"].sum()), "most": max(len(states), int(states["most"].max()))}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = spark.range(2000, numPartitions=4).select(F.lit("hot").alias("k"), F.col("id").alias("x"))
        got = uf.user_aggregate(rows, ["k"], "n long, most long", lambda g: {"n": len(g), "most": 0}, seen, fan_in=8).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["n"] == 2000 and got["most"] <= 30
    assert uf.user_aggregate(rows.limit(0), ["k"], "n long, most long", lambda g: {"n": len(g), "most": 0}, seen).count() == 0


@pytest.fixture(scope="module")
def ranked(spark):
    texts = ["Graph nodes rank well. Running graph systems store data! The of and.", "", None, "Big data", "of the", "one. two. three graph"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return tr.ranked_tokens(tt.with_tokens(docs)).cache()


def test_walk_equals_the_column_form(ranked):
    walked = sorted(map(tuple, tr.walked_spans(ranked).collect()))
    assert walked == sorted(map(tuple, tr.phrase_spans(ranked).collect())) and len(walked) == 3


def test_walk_shuffles_only_words_of_shared_keys(spark, ranked, capsys):
    walked = tr.walked_spans(ranked)
    walked.explain()
    assert "hashpartitioning" not in capsys.readouterr().out and walked.count() == 3
    docs = spark.createDataFrame([(1, "Old graph of data"), (2, "New nodes"), (2, "New nodes"), (None, "Wide graph"), (None, "of data")], "doc_id long, text string")
    got = sorted(map(str, tr.walked_spans(tr.ranked_tokens(tt.with_tokens(docs))).collect()))
    one = [(1, "Old graph", 0, True), (1, "data", 3, True), (2, "New", 0, True), (2, "New nodes", 0, True), (2, "nodes", 1, True)]
    assert [r for r in got if "doc_id=None" not in r] == sorted(f"Row(doc_id={d}, phrase='{p}', start={s}, noun={n})" for d, p, s, n in one)
    assert any("doc_id=None" in r for r in got)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_a_walk_goes_on_over_batches(size):
    """Whatever the batches, the same runs: a Python walk over the rows, and no object for a key."""
    rng = random.Random(size)
    rows = []
    for doc in [1, 2, None, 3]:
        for num in range(rng.choice([1, 12])):
            rows += [(doc, num, f"w{num}", rng.choice(["NN", "JJ"]), rng.random() < 0.7)] * rng.choice([1, 1, 2])
    want, run, last = [], [], None
    for r in [*rows, ("end", 0, "", "NN", False)]:
        if run and not (r[4] and r[0] == last[0] and r[1] == last[1] + 1):
            want.append((run[0][0], " ".join(x[2] for x in run), run[0][1], any(x[3] == "NN" for x in run)))
            run = []
        run, last = [*run, r] if r[4] else [], r
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    walk, got = uf.PhraseWalk(), []
    for k in range(0, len(rows), size):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows[k : k + size]), kinds)]
        got += walk.eval(pa.record_batch(columns, ["doc", "num", "raw", "pos", "kept"]))
    got = pa.concat_tables([*got, *walk.terminate()])
    assert list(zip(*[c.to_pylist() for c in got.columns])) == want and want


def test_phrases_that_end_with_their_sentence(spark):
    docs = spark.createDataFrame([(1, "Old graph. New data! Of the. Systems"), (2, "Graph of data. Nodes")], "doc_id long, text string")
    ranked = tr.ranked_tokens(tt.with_tokens(docs))
    over = {(r["doc_id"], r["phrase"]) for r in tr.noun_phrases(ranked).collect()}
    cut = {(r["doc_id"], r["phrase"]) for r in tr.noun_phrases(ranked, break_at_sentence=True).collect()}
    assert over == {(1, "old graph new data"), (1, "systems"), (2, "graph"), (2, "data nodes")}
    assert cut == {(1, "old graph"), (1, "new data"), (1, "systems"), (2, "graph"), (2, "data"), (2, "nodes")}
