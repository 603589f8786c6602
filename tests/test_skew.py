"""Skewed joins and dense ids: exact whatever the key distribution."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import messages, skew
from quillgraph.operators.ids import dense_ids
from quillgraph.sources.tables import write_bucketed


@pytest.fixture(scope="module")
def facts(spark):
    rnd = random.Random(4)
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}") for i in range(3000)]
    return spark.createDataFrame(rows, "i long, k string")


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([(f"k{j}", j) for j in range(30)] + [("hot", -1), ("unused", -2)], "k string, v long")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("min_rows", [10, 10**6])
def test_salted_join_is_a_plain_join(facts, lookup, how, min_rows):
    want = Counter(map(tuple, facts.join(lookup, "k", how).select("i", "k", "v").collect()))
    got = skew.salted_join(facts, lookup, ["k"], how, by=["i"], min_rows=min_rows, max_share=16)
    assert got.columns == ["k", "i", "v"]
    assert Counter(map(tuple, got.select("i", "k", "v").collect())) == want
    assert Counter(map(tuple, skew.lookup_join(facts, lookup, ["k"], how).select("i", "k", "v").collect())) == want


def test_hot_keys_are_split_evenly(facts):
    hot = skew.HotKeys(skew.count_keys(facts, ["k"]), ["k"], max_share=16, min_rows=10)
    parts = {r["k"]: r[skew.PARTS] for r in hot.table.collect()}
    assert parts["hot"] >= 4 and len(parts) <= 16
    sizes = hot.spread(facts, by=["i"]).filter("k = 'hot'").groupBy(skew.PART).count().collect()
    assert len(sizes) == parts["hot"] and max(s["count"] for s in sizes) < 2 * 900 / parts["hot"]
    spread_nulls = hot.spread(facts, by=["i"]).filter("k is null").select(skew.PART).distinct().count()
    assert spread_nulls > 100


def test_hot_list_is_bounded(spark):
    counts = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(50).cast("long").alias("n"))
    hot = skew.HotKeys(counts, ["k"], max_share=16, min_rows=1)
    assert hot.table.count() <= 16


def test_fits_broadcast(spark):
    df = spark.range(100).select("id", F.lit("x" * 100).alias("s"))
    assert skew.fits_broadcast(df)
    assert not skew.fits_broadcast(df, max_rows=99)
    assert not skew.fits_broadcast(df, max_bytes=5000)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_dense_ids(facts, partitions):
    ids = dense_ids(facts, "k", "id", first=5, partitions=partitions).collect()
    counts = Counter(r.k for r in facts.collect() if r.k is not None)
    assert {r.k: (r.id, r.n) for r in ids} == {k: (5 + i, counts[k]) for i, k in enumerate(sorted(counts))}


def test_sketched_hot_keys(spark, facts, lookup):
    """The sketch finds the hot key of a planted share in one pass that shuffles no key, and the join stays exact."""
    hot = skew.HotKeys.sketched(facts, "k", max_share=16, min_rows=10)
    counted = skew.HotKeys(skew.count_keys(facts, ["k"]), ["k"], max_share=16, min_rows=10)
    assert {r["k"]: r[skew.PARTS] for r in hot.table.collect()} == {r["k"]: r[skew.PARTS] for r in counted.table.collect()}
    assert not skew.HotKeys.sketched(facts.limit(0), "k").any and not skew.HotKeys.sketched(facts, "k").any
    pairs = facts.withColumn("j", F.col("i") % 3)
    wide = lookup.crossJoin(spark.range(3).withColumnRenamed("id", "j"))
    want = Counter(map(tuple, pairs.join(wide, ["k", "j"]).select("i", "k", "j", "v").collect()))
    got = skew.salted_join(pairs, wide, ["k", "j"], by=["i"], min_rows=10, max_share=16)
    assert Counter(map(tuple, got.select("i", "k", "j", "v").collect())) == want


def test_replies_read_the_facts_once_less(spark, monkeypatch):
    """No counting pass keyed by message: the only job before the join is the sketch."""
    monkeypatch.setattr(skew, "count_keys", lambda *a: pytest.fail("the facts were counted by key"))
    rows = [(str(k), str(k // 2) if k else "", f"s{k % 5}", "x") for k in range(200)] + [(f"h{k}", "7", "s1", "x") for k in range(300)]
    msg = spark.createDataFrame(rows, "id string, prev_thread string, sender string, subject string")
    want = Counter((p, i) for i, p, *_ in rows if p and p in {r[0] for r in rows})
    init = skew.HotKeys.__init__
    for min_rows in (100, 10**6):
        monkeypatch.setattr(skew.HotKeys, "__init__", lambda self, c, k, least=min_rows, **_: init(self, c, k, max_share=16, min_rows=least))
        got = Counter((r["id"], r["reply_id"]) for r in messages.replies(msg).collect())
        assert got == want


def test_bucketed_messages_are_not_shuffled(spark, tmp_path):
    rows = [(str(k), str(k // 2) if k else "", f"s{k % 5}", "x") for k in range(500)]
    msg = spark.createDataFrame(rows, "id string, prev_thread string, sender string, subject string")
    kept = write_bucketed(msg, "bucketed_messages", str(tmp_path / "t"), ["id"], 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = messages.replies(kept)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # the answers, keyed by what they answer
        assert Counter(map(tuple, joined.collect())) == Counter(map(tuple, messages.replies(msg).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_messages")
