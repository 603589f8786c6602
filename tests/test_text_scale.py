"""Texts that are tagged on the way: the same results, in bounded pieces, with nothing stored."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import arrow_text as at
from quillgraph.operators import text as tt
from quillgraph.operators import textrank as tr
from quillgraph.plans.catalog import QUERIES
from quillgraph.streaming import word_count as wc

ROWS = [(1, "Boats drift under wide bridges. Boats rest."), (2, ""), (3, None), (3, "Boats drift. Boats sink"), (None, "Wide rivers, wide boats"),
        (1, "Boats drift under wide bridges. Boats rest.")]


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    return docs, tt.untagged(docs), tt.with_tokens(docs)


def rows(df):
    return Counter(map(str, df.collect()))


def test_untagged_texts_give_what_tagged_words_give(both):
    _, plain, tokened = both
    vocab = tt.vocabulary(plain)
    assert rows(vocab) == rows(tt.vocabulary(tokened))
    makers = [tt.token_rows, tt.tile_rows, tt.window_link_rows, lambda t: tt.graf_nodes(tt.numbered(t, vocab)), lambda t: tt.graf_edges(tt.numbered(t, vocab), distinct=True),
              lambda t: tt.word_table(tt.stem_table(t)), lambda t: tt.word_table(tt.stem_table(t, stemmer=F.upper)), lambda t: tr.word_ranks(tr.ranked_tokens(t))]
    for make in makers:
        assert rows(make(plain)) == rows(make(tokened)) != Counter()


def test_records_numbered_on_the_way(spark, both):
    _, plain, tokened = both
    lexicon = spark.createDataFrame([("wide", 0.5, 1.0), ("boats", -1.0, 0.5)], "word string, polr double, subj double")
    vocab = tt.vocabulary(plain)
    assert rows(tt.sentence_records(plain, lexicon, vocab=vocab)) == rows(tt.sentence_records(tt.numbered(tokened, vocab), lexicon)) != Counter()


def test_words_with_ids_are_not_stored(both, monkeypatch):
    _, plain, _ = both
    vocab = tt.vocabulary(plain).localCheckpoint()
    monkeypatch.setattr("pyspark.sql.DataFrame.checkpoint", lambda *a, **k: pytest.fail("stored"))
    assert tt.graf_nodes(tt.numbered(plain, vocab)).count() > 0


def test_texts_with_ids_are_shuffled_once(spark, both, capsys):
    docs, plain, tokened = both
    lexicon = spark.createDataFrame([("wide", 0.5, 1.0)], "word string, polr double, subj double")
    vocab = tt.vocabulary(plain).localCheckpoint()
    for made in (tt.numbered(plain, vocab), tt.stem_table(tokened), tt.sentence_records(plain, lexicon, vocab=vocab)):
        assert made.collect()
        made.explain("formatted")
        plan = capsys.readouterr().out
        nodes = re.findall(r"[ -]Exchange \((\d+)\)", plan.split("Initial Plan")[0])
        moved = [re.search(rf"^\({k}\) Exchange\s*\nInput \[\d+\]: (.*)", plan, re.M)[1] for k in nodes]
        assert sum("paras" in columns or "toks" in columns for columns in moved) == 1, plan


def test_every_text_of_a_block_has_its_dictionary(spark, monkeypatch):
    """Blocks of many texts, cut into batches of one row: only the first row of a block brings its words."""
    monkeypatch.setattr(tt, "BLOCKS_A_PARTITION", 1)
    docs = spark.createDataFrame([(k, f"boats drift number{k % 7}") for k in range(200)] + [(None, None), (7, "")], "doc_id long, text string")
    plain = tt.untagged(docs)
    vocab = tt.vocabulary(plain)
    rows_a_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = tt.graf_nodes(tt.numbered(plain, vocab)).select("root", "node_id", "keep").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    ids = {r["root"]: r["node_id"] for r in vocab.collect()}
    assert len(got) == 600 and all(r["node_id"] == (ids[r["root"]] if r["keep"] else 0) for r in got) and ids


def test_stem_counts_shuffle_no_text(spark, both, monkeypatch, tmp_path):
    docs, plain, tokened = both
    first = lambda word: F.substring(word, 1, 2)
    want = rows(tt.word_table(tt.stem_table(tokened, stemmer=first)).groupBy("id", "word", "stem").agg(F.count(F.lit(1)).alias("num")))
    monkeypatch.setattr(tt, "_in_blocks", lambda *a, **k: pytest.fail("texts dealt to blocks"))
    assert rows(tt.stem_counts(plain, stemmer=first)) == rows(tt.stem_counts(tokened, stemmer=first)) == want != Counter()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["porter_words"](spark, str(tmp_path)).agg(F.sum("num")).first()[0] == tt.token_rows(plain).count()


def test_term_counts_in_rows(both):
    docs, _, _ = both
    want = tt.term_counts(tt.plain_words(docs)).select("doc_id", "word", "num")
    assert rows(tt.text_term_counts(docs)) == rows(want)


def test_batches_are_gone_through_in_pieces():
    """A batch of many texts never becomes one array: pieces hold about PIECE words, or one text."""
    ends = np.arange(0, 40 * at.PIECE + 1, at.PIECE // 4)
    cuts = list(at._cuts(ends))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(ends) - 1 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert max(ends[hi] - ends[lo] for lo, hi in cuts) <= at.PIECE
    assert list(at._cuts(np.array([0, 5 * at.PIECE, 5 * at.PIECE + 1]))) == [(0, 1), (1, 2)]


def test_ranks_are_handed_on_piece_by_piece(monkeypatch):
    monkeypatch.setattr(at, "PIECE", 3)
    words = pa.array([[["Boats", "drift"]], [["wide", "boats"]], None, [["rivers"]]], pa.list_(pa.list_(pa.string())))
    parts = list(tr._rank_udf("tiles", True, 1e-4, None, True).func(iter([words])))
    assert len(parts) > 1 and sum(map(len, parts)) == 4 and sum(p.null_count for p in parts) == 1


def test_partial_counts_come_once_per_word():
    import pandas as pd

    batches = [pd.DataFrame({"word": ["a", "b", "a"]}), pd.DataFrame({"word": ["a", "c"]})]
    got = pd.concat(wc._partial_counts(iter(batches)))
    assert sorted(zip(got["word"], got["n"])) == [("a", 3), ("b", 1), ("c", 1)]


def test_forms_are_tagged_together_as_one_by_one():
    """Each rule is asked of all distinct words at once, and gives what it gives word by word."""
    stems = ["", "b", "Bo", "wid", "Wid", "runn", "STUD", "walk", "glass", "church", "x", "İz", "ΟΔΟΣ", "é", "7", "a7", "_", "_A", "Z", "Z~", "ﬁn", "d's", "10-Ton"]
    ends = ["", "s", "es", "ies", "ing", "ed", "ly", "est", "er", "ous", "ness", "tion", "ize", "ify", "ss", "us", "is", "S", "ING", "ches", "xes"]
    words = sorted({a + b for a in stems for b in [*ends, *(e for _, _, found in at._SUFFIXES for e in found)]} - {""} | set(at._CLOSED) | {w.title() for w in at._CLOSED})
    start, later, low, root = at.tag_forms(pa.array(words))
    got = [(at._TAGS[s], at._TAGS[x], w, r) for s, x, w, r in zip(start, later, low.to_pylist(), root.to_pylist())]
    tags = [(at.tag_word(w, w.lower(), True), at.tag_word(w, w.lower(), False), w.lower()) for w in words]
    assert got == [(s, x, w, at.lemma_word(w, x)) for s, x, w in tags] == [(s, x, w, at.lemma_word(w, s)) for s, x, w in tags]
    assert len({x for _, x, _, _ in got}) == len(at._TAGS)


def test_packed_texts_give_what_lists_of_words_give(spark):
    texts = ["Boats drift. !!! Wide-bridges can't sink?\n\n__ of _x9", "", None, "...", " . Two  words", "çé ١٢ a_b"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(tt.tx.blocks(F.col("text")).alias("p"))
    got = docs.select(tt._split(F.col("p")).alias("lists"), tt.tx.packed(F.col("p")).alias("packed")).toArrow().combine_chunks()
    tagged = at.tagger()
    lists, packed = (tagged(got.column(c).chunk(0)).to_pylist() for c in ("lists", "packed"))
    assert packed == lists and [x is None for x in packed] == [x is None for x in texts] and packed[0][2]["sent"] == 2
    old = docs.select(F.transform(tt.tx.sentences(F.col("p")), lambda s: F.regexp_extract_all(s, F.lit(tt.tx.WORD), F.lit(0))).alias("lists"))
    assert [r["lists"] for r in old.collect()] == got.column("lists").to_pylist()


def test_edges_are_made_where_ids_are_looked_up(spark, both):
    """Words with ids come back from Python only if something asks for them: not for edges."""
    _, plain, tokened = both
    for texts in (plain, tokened):
        words, stems = tt.numbered(texts, tt.vocabulary(texts)), tt.stem_table(texts)
        for one, other in ((tt.graf_edges(words), tt.graf_edges(words.select("*"))), (tt.link_edges(stems), tt.link_edges(stems.select("*"))),
                           (tt.graf_edges(words, distinct=True), tt.graf_edges(words.select("*"), distinct=True))):
            assert rows(one) == rows(other) != Counter()
            plan, longer = (df._jdf.queryExecution().optimizedPlan().toString() for df in (one, other))
            assert "graf" not in plan and "graf" in longer


def test_scores_are_broadcast_if_small(spark, both, monkeypatch):
    _, plain, _ = both
    lexicon = spark.createDataFrame([("wide", 0.5, 1.0), ("boats", -1.0, 0.5), (None, 9.0, 9.0)], "word string, polr double, subj double")
    vocab = tt.vocabulary(plain)
    small = rows(tt.sentence_records(plain, lexicon, vocab=vocab))
    monkeypatch.setattr(tt, "fits_broadcast", lambda df: False)
    assert rows(tt.sentence_records(plain, lexicon, vocab=vocab)) == small != Counter()
