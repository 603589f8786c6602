"""Message and listing operators against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import meetups as mt
from quillgraph.operators import messages as ms
from quillgraph.operators import skew


@pytest.fixture(scope="module")
def rows():
    """Messages with a hot message, self-replies, several answers by one person, no answers."""
    rnd = random.Random(9)
    out = []
    for i in range(400):
        prev = "" if i == 0 or rnd.random() < 0.2 else "0" if rnd.random() < 0.4 else str(rnd.randrange(i))
        out.append((str(i), f"user{rnd.randrange(12)}", prev if rnd.random() < 0.97 else None, f"subject {i % 7}" if i % 5 else None))
    return out


@pytest.fixture(scope="module", params=["plain", "split"])
def msg(request, spark, rows):
    mp = pytest.MonkeyPatch()
    if request.param == "split":
        init = skew.HotKeys.__init__
        mp.setattr(skew.HotKeys, "__init__", lambda self, c, k, **_: init(self, c, k, max_share=50, min_rows=5))
    yield spark.createDataFrame(rows, "id string, sender string, prev_thread string, subject string")
    mp.undo()


def pairs(rows):
    by_id = {r[0]: r for r in rows}
    return [(by_id[r[2]], r) for r in rows if r[2] and r[2] in by_id]


def test_replies(msg, rows):
    got = Counter((r.id, r.reply_id, r.subject, r.sender, r.receiver) for r in ms.replies(msg).collect())
    assert got == Counter((a[0], b[0], a[3], a[1], b[1]) for a, b in pairs(rows))


def test_self_replies(msg, rows):
    own = [(a, b) for a, b in pairs(rows) if a[1] == b[1]]
    assert Counter((r.id, r.reply_id) for r in ms.self_replies(msg).collect()) == Counter((a[0], b[0]) for a, b in own)
    assert ms.self_reply_count(msg).first().num == len(own)
    want = Counter(a[1] for a, b in own if a[3] is not None)
    assert {r.sender: r.num for r in ms.self_repliers(msg).collect() if r.num} == want


@pytest.mark.parametrize("dedup", [True, False])
def test_conversations_and_dead_ends(msg, rows, dedup):
    met = [(a[0], b[1], a[1]) for a, b in pairs(rows) if a[1] != b[1]]
    want = Counter((replier, sender) for _, replier, sender in (set(met) if dedup else met))
    assert {(r.replier, r.sender): r.num for r in ms.conversations(msg, dedup=dedup).collect()} == want
    top = [(r.num, r.replier, r.sender) for r in ms.top_conversations(msg, 5, dedup=dedup).collect()]
    assert top == sorted(((n, *k) for k, n in want.items()), key=lambda x: (-x[0], x[1], x[2]))[:5]
    assert ms.dead_ends(msg, dedup=dedup).first().dead_ends == len(rows) - sum(want.values())


def test_dead_end_messages(msg, rows):
    answered = {a[0] for a, b in pairs(rows) if a[1] != b[1]}
    assert {r.id for r in ms.dead_end_messages(msg).collect()} == {r[0] for r in rows} - answered


def test_reply_graph(msg, rows):
    ids = ms.sender_ids(msg)
    table = {r.sender: r.id for r in ms.reply_nodes(ids).collect()}
    assert table == {s: i for i, s in enumerate(sorted({r[1] for r in rows}))}
    edges = ms.reply_edges(msg, ids)
    want = {(table[r.replier], table[r.sender]): r.num for r in ms.conversations(msg).collect()}
    assert {(r.replier, r.sender): r.num for r in edges.collect()} == want
    names = ms.names_for(edges.select(F.col("replier"), "num"), ids, "replier", "name")
    assert all(table[r.name] == r.replier for r in names.collect())


def test_top_senders_and_activity(spark, rows):
    df = spark.createDataFrame([(r[1], int(r[0])) for r in rows], "sender string, date int")
    counts = Counter(r[1] for r in rows)
    top = [(r.sender, r.num) for r in ms.top_senders(df, 4).collect()]
    assert top == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]
    for r in ms.activity(df, "sender", "date").collect():
        mine = [int(x[0]) for x in rows if x[1] == r.sender]
        assert (r.num, r.earliest, r.latest) == (len(mine), min(mine), max(mine))


def test_attendance_keeps_groups_without_meta(spark):
    listing = spark.createDataFrame(
        [("g1", "A", 3), ("g1", "A", 4), ("g1", "B", 5), ("g2", "A", 1), ("", "A", 9)], "base_url string, city string, reg int"
    )
    meta = spark.createDataFrame([("g1", "EU", "c", "e"), ("g1", "US", "c2", "e2")], "base_url string, region string, contact string, email string")
    got = Counter((r.base_url, r.region, r.city, r.attendance, r.num) for r in mt.attendance(listing, meta).collect())
    assert got == Counter(
        [("g1", "EU", "A", 7, 2), ("g1", "US", "A", 7, 2), ("g1", "EU", "B", 5, 1), ("g1", "US", "B", 5, 1), ("g2", None, "A", 1, 1)]
    )


def test_speakers_and_url_position(spark):
    df = spark.createDataFrame(
        [("d", "t", "x/spark-users/1", "Ada, Bo"), ("d", "t", "y", "Bo"), ("d", "t", "/spark-users/", "")],
        "date string, title string, url string, speakers string",
    )
    assert [(r.speaker, r.num) for r in mt.speaker_counts(df).collect()] == [("Bo", 2), ("", 1), ("Ada", 1)]
    assert sorted(r.pos for r in mt.at_url(df, "/spark-users/").collect()) == [0, 1]


def test_stratified_sample(spark):
    rows = spark.range(20000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 30, "tiny").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("k")
    )
    sizes = {r.k: r.n for r in mt.stratum_fractions(rows, "k", 200).collect()}
    kept = defaultdict(set)
    for r in mt.stratified_sample(rows, "k", "id", 200).collect():
        kept[r.k].add(r.id)
    assert len(kept["tiny"]) == sizes["tiny"] and kept.keys() == sizes.keys()
    assert all(120 < len(kept[k]) < 300 for k in sizes if sizes[k] > 1000)
    again = {r.id for r in mt.stratified_sample(rows.repartition(5), "k", "id", 200).collect()}
    assert again == set().union(*kept.values())


def test_engagement_limits(spark):
    df = spark.sql("select 'a' as affil, timestamp'2024-01-01 00:00:00' as at union all select 'a', timestamp'2024-01-02 01:30:00'")
    r = ms.engagement(df, "affil", "at", 10).first()
    assert r.num == 2 and r.duration == pytest.approx(1 + 1.5 + 30) and r.duration_days == pytest.approx(1.0625)
