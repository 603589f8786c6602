"""The pipeline's stages on small tables and on awkward rows."""

import collections
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillgraph.llm import decision_list, ngram_join
from tests.llm.test_operators import DOCS, counts, ngram_set, plain_targets, words

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each one."""
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, made[-1], FOLDER).write.parquet(f"{out}/{k}")
        made.append(spark.read.parquet(f"{out}/{k}"))
    return made


def test_columns_stay_those_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "n_tokens", "bucket", "padded_length", "batch"]


def test_rules_drop_what_the_base_drops(spark, stages):
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for r in stages[0].collect():
        n, _, _, _, repeated = counts(r["text"])
        if n < 10 or 100 * repeated > 20 * n:
            assert r["doc_id"] not in kept
        elif labels.get(r["doc_id"]) == 1 and not set(r["text"]) & set(decision_list.SYMBOLS + "!"):
            assert r["doc_id"] in kept


def test_classifier_keeps_most_of_its_input(stages):
    assert stages[2].count() >= 0.9 * stages[1].count()


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = ({r["doc_id"]: ngram_set(r["text"]) for r in s.collect()} for s in stages[2:4])
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    ids = sorted(after)
    assert not any(near(after[a], after[b]) for k, a in enumerate(ids) for b in ids[:k])
    component = {r["doc_id"]: r["component_id"] for r in ngram_join.join(stages[2]).collect()}
    assert set(after) == {d for d in before if component[d] == d}


def test_mix_takes_the_targets(stages):
    rows = stages[3].collect()
    copies = collections.Counter(r["doc_id"] for r in stages[4].collect())
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
        taken[r["source"]] += len(words(r["text"])) * copies[r["doc_id"]]
    longest, want = max(len(words(r["text"])) for r in rows), plain_targets(sizes)
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= longest for s in sizes)


def test_packing_returns_every_row(stages):
    assert stages[5].groupBy("doc_id").count().exceptAll(stages[4].groupBy("doc_id").count()).isEmpty()
    assert stages[5].filter("n_tokens > padded_length").isEmpty()


def test_run_is_the_stages_in_order(spark, stages):
    key = ["doc_id", "n_tokens", "bucket", "padded_length", "batch"]
    assert sorted(map(tuple, cp.run(spark, FOLDER).select(key).collect())) == sorted(map(tuple, stages[-1].select(key).collect()))


def test_awkward_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (2, None, "en", None, 0), (3, "", "en", "b", 0), (4, text + " x", None, "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("mine"), "score": F.lit(2), "shard": F.lit(3), "n_words": F.lit(4)})
    for data in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            got = stage(spark, data, FOLDER)
            assert got.count() <= 3 * data.count() and set(data.columns) <= set(got.columns)
    near = cp.near_duplicates(spark, docs, FOLDER)
    assert sorted((r["doc_id"], r["text"]) for r in near.collect() if r["text"]) == [(1, text)]
    assert near.filter("text is null or text = ''").count() == 2
    assert near.filter("kept = 'mine' and shard = 3").count() == near.count()
