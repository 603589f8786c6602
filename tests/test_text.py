"""Token tables, word graphs and key phrases against plain-Python re-statements."""

import itertools
import random
import statistics
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import graph as gr
from quillgraph.operators import text as tt
from quillgraph.operators import textrank as tr

WORDS = "the of graph bridge harbours painting boats quietly wooden oars lantern under windy rivers is are Oslo café".split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(11)
    rows = [(0, ""), (1, "the of to."), (2, "graph"), (3, "graph. graph. graph."), (4, None)]
    for i in range(5, 60):
        text = " ".join(rnd.choice(WORDS) + (rnd.choice([".", ",", " -"]) if rnd.random() < 0.2 else "") for _ in range(rnd.randrange(1, 60)))
        rows.append((i, text))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def tokened(docs):
    return tt.with_tokens(docs).cache()


@pytest.fixture(scope="module")
def toks(tokened):
    return {r.doc_id: r.toks or [] for r in tokened.collect()}


def plain_tiles(ts, size=3):
    """All pairs of kept words of a sentence whose places differ by at most ``size``."""
    kept = [t for t in ts if t.keep == 1]
    pairs = itertools.combinations(sorted(kept, key=lambda t: t.num), 2)
    return [(a, b) for a, b in pairs if a.sent == b.sent and b.num - a.num <= size]


def plain_links(ts):
    sents = defaultdict(list)
    for t in ts:
        sents[t.sent].append(t)
    for s in sents.values():
        for a, b, c in zip(s, s[1:], s[2:]):
            for x in (b, c):
                if a.pos in tx.SMALL_KEEP_TAGS and x.pos in tx.SMALL_KEEP_TAGS and a.raw.lower() != x.raw.lower():
                    yield a, x


def test_tiles(tokened, toks):
    got = Counter((r.doc_id, r.root0, r.root1, r.num0, r.num1) for r in tt.tile_rows(tokened).collect())
    assert got == Counter((d, a.root, b.root, a.num, b.num) for d, ts in toks.items() for a, b in plain_tiles(ts))


def test_five_kept_words_give_nine_tiles(spark):
    five = tt.with_tokens(spark.createDataFrame([(1, "graph node word set rank")], "doc_id long, text string"))
    assert tt.tile_rows(five).count() == 9


def test_window_links(tokened, toks):
    got = Counter((r.doc_id, r.num0, r.num1) for r in tt.window_link_rows(tokened).collect())
    assert got == Counter((d, a.num, b.num) for d, ts in toks.items() for a, b in plain_links(ts))


def test_vocabulary_nodes_and_edges(tokened, toks):
    vocab = tt.vocabulary(tokened)
    ids = {r.root: r.node_id for r in vocab.collect()}
    roots = sorted({t.root for ts in toks.values() for t in ts if t.keep})
    assert ids == {r: i + 1 for i, r in enumerate(roots)}
    words = tt.numbered(tokened, vocab)
    got = Counter((r.doc_id, r.num, r.node_id) for r in tt.graf_nodes(words).collect())
    assert got == Counter((d, t.num, ids[t.root] if t.keep else 0) for d, ts in toks.items() for t in ts)
    edges = Counter((r.doc_id, r.node0, r.node1) for r in tt.graf_edges(words).collect())
    want = Counter()
    for d, ts in toks.items():
        for a, b in plain_tiles(ts):
            want[(d, ids[a.root], ids[b.root])] += 1
            want[(d, ids[b.root], ids[a.root])] += 1
    assert edges == want
    assert tt.graf_edges(words, distinct=True).count() == len(want)


def test_word_table_and_link_edges(tokened, toks):
    words = tt.stem_table(tokened)
    ids = {r.stem: r.id for r in tt.word_table(words).collect()}
    assert sorted(ids.values()) == list(range(len(ids)))
    got = Counter((r.doc_id, r.n0, r.n1) for r in tt.link_edges(words).collect())
    want = Counter()
    for d, ts in toks.items():
        for a, b in plain_links(ts):
            want[(d, ids[a.root], ids[b.root])] += 1
            want[(d, ids[b.root], ids[a.root])] += 1
    assert got == want


def test_sentiment_and_records(spark, docs, tokened, toks):
    lexicon = spark.createDataFrame([("graph", 0.5, 1.0), ("quietly", -1.0, 0.5)], "word string, polr double, subj double")
    scores = {(r.doc_id, r.sent): (r.polr, r.subj) for r in tt.sentiment(tt.plain_words(docs), lexicon).collect()}
    table = {"graph": (0.5, 1.0), "quietly": (-1.0, 0.5)}
    found = defaultdict(list)
    for d, ts in toks.items():
        for t in ts:
            if t.raw.lower() in table:
                found[(d, t.sent)].append(table[t.raw.lower()])
    assert scores == {k: (pytest.approx(sum(x[0] for x in v) / len(v)), pytest.approx(sum(x[1] for x in v) / len(v))) for k, v in found.items()}
    records = tt.sentence_records(tt.numbered(tokened, tt.vocabulary(tokened)), lexicon).collect()
    assert sum(r.size for r in records) == sum(len(ts) for ts in toks.values())
    assert sum(len(r.tile) for r in records) == sum(1 for ts in toks.values() for _ in plain_tiles(ts))
    for r in records:
        assert (r.polr, r.subj) == scores.get((r.doc_id, r.sent), (0.0, 0.0))
        assert [t.num for t in r.graf] == sorted(t.num for t in r.graf)


ODD = "Straße İstanbul ΟΔΟΣ ªb café's re-run CITIES Boxes goes running 9lives _x_y Z~ Ünder ties bus 中文字 it's a-b's 3rd"


def test_default_tagger_equals_its_column_form(spark, docs):
    """The batch tagger and the column expressions are two forms of one rule."""
    texts = docs.unionByName(spark.createDataFrame([(901, ODD + ". " + ODD), (902, None), (903, ""), (904, "... !"), (905, "One.\n\n?\n\nTwo two")], "doc_id long, text string"), True)
    want = texts.select("doc_id", tx.tokens(F.col("text")).alias("toks"))
    assert sorted(tt.with_tokens(texts).collect(), key=str) == sorted(want.collect(), key=str)


def test_word_graphs_shuffle_no_token(spark, tokened):
    """Nodes, edges and records come out of rows of whole texts: no window, only rows and their dictionaries are shuffled."""
    vocab = spark.createDataFrame(tt.vocabulary(tokened).collect())
    words = tt.numbered(tokened, vocab)
    lexicon = spark.createDataFrame([("graph", 0.5, 1.0)], "word string, polr double, subj double")
    for made in (tt.graf_nodes(words), tt.graf_edges(words), tt.graf_edges(words, distinct=True), tt.sentence_records(words, lexicon)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        dealt = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
        assert dealt and all("hashpartitioning(_row" in line for line in dealt)


def test_tagging_hooks(spark, tokened, toks):
    @F.pandas_udf("array<string>")
    def model(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else ["JJ" if w == "graph" else "SYM" for w in ws])

    again = tt.retagged(tokened, model(F.transform("toks", lambda t: t["raw"])))
    for r in again.collect():
        assert [t.pos for t in r.toks or []] == ["JJ" if t.raw == "graph" else "SYM" for t in toks[r.doc_id]]
    lexicon = spark.createDataFrame([("graph", "JJ"), ("the", "SYM")], "word string, pos string")
    for r in tt.lexicon_tagged(tokened, lexicon).collect():
        kept = [t for t in toks[r.doc_id] if t.raw.lower() != "the"]
        assert [t.num for t in r.toks] == list(range(len(kept)))
        assert [t.pos for t in r.toks] == ["JJ" if t.raw == "graph" else t.pos for t in kept]


def plain_ranks(vertices, edges, tol=1e-4):
    out = Counter(a for a, _ in edges)
    rank = {v: 1.0 for v in vertices}
    change = 1.0
    while vertices and change > tol:
        fresh = {v: 0.15 for v in vertices}
        for a, b in edges:
            fresh[b] += 0.85 * rank[a] / out[a]
        change = max(abs(fresh[v] - rank[v]) for v in vertices)
        rank = fresh
    return rank


@pytest.mark.parametrize("links,distinct", [("tiles", True), ("tiles", False), ("window", False)])
def test_ranks(tokened, toks, links, distinct):
    got = {(r.doc_id, r.root): r.rank for r in tr.word_ranks(tr.ranked_tokens(tokened, links=links, distinct=distinct)).collect()}
    want = {}
    for d, ts in toks.items():
        pairs = [(a.root, b.root) for a, b in (plain_tiles if links == "tiles" else plain_links)(ts)]
        pairs += [(b, a) for a, b in pairs]
        kept = {t.root for t in ts if (t.keep if links == "tiles" else t.pos in tx.SMALL_KEEP_TAGS)}
        for root, rank in plain_ranks(kept, sorted(set(pairs)) if distinct else pairs).items():
            want[(d, root)] = rank
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_in_row_ranks_equal_graph_ranks(spark, tokened):
    """The in-row ranks of all documents against one graph job over their disjoint union."""
    pairs = tt.tile_rows(tokened).select("doc_id", "root0", "root1")
    both = tt.both_ways(pairs, "root0", "root1").distinct()
    vertex = lambda c: F.xxhash64("doc_id", c)
    edges = both.select(vertex("root0").alias("src"), vertex("root1").alias("dst"))
    ranks = gr.pagerank(gr.vertices_of(edges), edges, rounds=8)
    in_row = tr.word_ranks(tr.ranked_tokens(tokened, tol=0.0, max_rounds=8)).select(vertex("root").alias("id"), F.col("rank").alias("r"))
    worst = ranks.join(in_row, "id").agg(F.max(F.abs(F.col("rank") - F.col("r"))).alias("d"), F.count("*").alias("n")).first()
    assert worst.n == gr.vertices_of(edges).count() and worst.d < 1e-12


def plain_phrases(ts, rank, *, nouns):
    """Runs of chosen words, found as groups of equal place minus running number."""
    rounded = {k: round(r, 9) for k, r in rank.items()}
    floor = 0 if nouns or not rank else statistics.median(rounded.values())
    chosen = [t for t in ts if t.keep == 1 and (nouns or rounded[t.root] >= floor)]
    phrases = {}
    for _, group in itertools.groupby(enumerate(chosen), key=lambda kt: kt[1].num - kt[0]):
        run = [t for _, t in group]
        if nouns and all(t.pos[0] != "N" for t in run):
            continue
        name = " ".join(t.raw.lower() if nouns else t.raw for t in run)
        phrases[name] = round(sum(rank[t.root] for t in run), 9)
    if phrases and not nouns:
        middle = statistics.median(phrases.values())
        phrases = {p: r for p, r in phrases.items() if r >= middle}
    return {p: r / sum(phrases.values()) for p, r in phrases.items()}


@pytest.mark.parametrize("nouns", [True, False])
def test_phrases(tokened, toks, nouns):
    ranked = tr.ranked_tokens(tokened)
    ranks = defaultdict(dict)
    for r in tr.word_ranks(ranked).collect():
        ranks[r.doc_id][r.root] = r.rank
    found = (tr.noun_phrases if nouns else tr.summary_phrases)(ranked).collect()
    got = {(r.doc_id, r.phrase): r.norm_rank for r in found}
    want = {(d, p): x for d, ts in toks.items() for p, x in plain_phrases(ts, ranks[d], nouns=nouns).items()}
    assert got.keys() == want.keys() and len(found) == len(got)
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
