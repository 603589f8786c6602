"""Token, vocabulary and word-graph tables made from the token array of each message.

Operators that take ``tokened`` texts take (doc, toks), or the texts of ``untagged``, whose words they tag in the
pass that uses them: tagged words are then neither kept nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from quillgraph.functions import arrow_text as at
from quillgraph.functions import text as tx
from quillgraph.operators.ids import dense_ids
from quillgraph.operators.skew import fits_broadcast, lookup_join, salted_join
from quillgraph.session import durable

#: blocks of texts that share a dictionary, for each shuffle partition
BLOCKS_A_PARTITION = 4


def explode_rows(df: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    """One row per array element.

    The outer form plus a filter above it: the inner form makes the optimizer add a
    filter that evaluates the whole array expression a second time.
    """
    return df.select(*keys, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def with_tokens(docs: DataFrame, text: str = "text", doc: str = "doc_id", *, parts=tx.blocks) -> DataFrame:
    """(doc, toks): the tagged token array of each text; ``parts=tx.paragraphs`` for mails.

    By the default tagger, which runs once per distinct word of a batch; ``tx.tokens`` is the same as
    a column expression and takes other taggers.
    """
    return docs.select(doc, at.tagged_words(tx.sentences(parts(F.col(text)))).alias("toks"))


def untagged(docs: DataFrame, text: str = "text", doc: str = "doc_id", *, parts=tx.blocks) -> DataFrame:
    """(doc, paras): the paragraphs of each text, for operators that run the default tagger themselves."""
    return docs.select(doc, parts(F.col(text)).alias("paras"))


def words_of(tokened: DataFrame) -> tuple[Column, bool]:
    """Tagged words or ``packed`` words, and whether they are still to be tagged."""
    return (F.col("toks"), False) if "toks" in tokened.columns else (tx.packed(F.col("paras")), True)


def _split(paras: Column) -> Column:
    return F.transform(tx.sentences(paras), tx.words)


def paragraph_rows(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    paras = F.transform(tx.paragraphs(F.col(text)), lambda p, i: F.struct(i.alias("para"), p.alias("text")))
    return explode_rows(docs, [doc], paras, "p").select(doc, "p.*")


def sentence_rows(docs: DataFrame, text: str = "text", doc: str = "doc_id", *, parts=tx.blocks) -> DataFrame:
    sents = F.transform(tx.sentences(parts(F.col(text))), lambda s, i: F.struct(i.alias("sent"), s.alias("text")))
    return explode_rows(docs, [doc], sents, "s").select(doc, "s.*")


def sentence_offsets(docs: DataFrame, text: str = "text", doc: str = "doc_id", *, parts=tx.blocks) -> DataFrame:
    """Word count of each sentence and the number of words before it in the text."""
    sizes = docs.select(doc, tx.sentence_sizes(tx.sentences(parts(F.col(text)))).alias("sizes"))
    pairs = F.zip_with("sizes", tx.sentence_starts(F.col("sizes")), lambda n, at: F.struct(n.alias("n_words"), at.alias("start")))
    return explode_rows(sizes, [doc], F.transform(pairs, lambda p, i: F.struct(i.alias("sent"), p["n_words"], p["start"])), "s").select(doc, "s.*")


def token_rows(tokened: DataFrame, doc: str = "doc_id") -> DataFrame:
    words, tag = words_of(tokened)
    return explode_rows(tokened, [doc], at.tag_udf()(words) if tag else words, "t").select(doc, "t.*")


def retagged(tokened: DataFrame, tags: Column, *, lemmatizer=tx.lemma) -> DataFrame:
    """The same words with other tags: ``tags`` is an array<string>, one tag per word.

    The hook for a tagging model, for instance a pandas UDF over
    ``transform(toks, t -> t.raw)``.
    """
    def word(t: Column, pos: Column) -> Column:
        return F.struct(
            t["sent"].alias("sent"), t["num"].alias("num"), t["raw"].alias("raw"),
            lemmatizer(F.lower(t["raw"]), pos).alias("root"), pos.alias("pos"), tx.keep(pos).alias("keep"),
        )

    return tokened.withColumn("_tags", tags).withColumn("toks", F.zip_with("toks", "_tags", word)).drop("_tags")


def text_term_counts(docs: DataFrame, text: str = "text", doc: str = "doc_id", *, parts=tx.blocks) -> DataFrame:
    """(doc, word, num): ``term_counts`` of the ``plain_words`` of each text, counted within its row before any shuffle."""
    rows = docs.select(doc, _split(parts(F.col(text))).alias("_words"))
    schema = StructType([StructField(doc, docs.schema[doc].dataType), *DataType.fromDDL("word string, n long").fields])
    counted = rows.mapInArrow(at.count_in_rows(doc, "_words"), schema)
    return counted.groupBy(doc, F.lower("word").alias("word")).agg(F.sum("n").alias("num"))


def lexicon_tagged(tokened: DataFrame, lexicon: DataFrame, doc: str = "doc_id", *, lemmatizer=tx.lemma) -> DataFrame:
    """(doc, toks) with tags from a table (word, pos) where it has the word, else as before.

    Symbols (``SYM``) drop out and take no position.  A message's words come back together
    by its key; they were one row before.
    """
    rows = lookup_join(
        token_rows(tokened, doc).withColumn("word", F.lower("raw")),
        lexicon.select("word", F.col("pos").alias("_pos")),
        ["word"],
        "left",
        by=[doc, "num"],
    )
    pos = F.coalesce("_pos", "pos")
    words = rows.filter(pos != "SYM").select(doc, F.struct("num", "sent", "raw", pos.alias("pos")).alias("w"))
    grouped = words.groupBy(doc).agg(F.array_sort(F.collect_list("w")).alias("ws"))

    def word(w: Column, num: Column) -> Column:
        return F.struct(
            w["sent"].alias("sent"), num.alias("num"), w["raw"].alias("raw"),
            lemmatizer(F.lower(w["raw"]), w["pos"]).alias("root"), w["pos"].alias("pos"), tx.keep(w["pos"]).alias("keep"),
        )

    return grouped.select(doc, F.transform("ws", word).alias("toks"))


def plain_words(docs: DataFrame, text: str = "text", doc: str = "doc_id", *, parts=tx.blocks) -> DataFrame:
    """(doc, sent, num, word): lower-case words without tags, for operators that need none."""
    in_sentence = lambda s, i: F.transform(tx.words(s), lambda w: F.struct(i.alias("sent"), F.lower(w).alias("word")))
    flat = F.flatten(F.transform(tx.sentences(parts(F.col(text))), in_sentence))
    rows = F.transform(flat, lambda w, num: F.struct(w["sent"].alias("sent"), num.alias("num"), w["word"].alias("word")))
    return explode_rows(docs, [doc], rows, "w").select(doc, "w.*")


def term_counts(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counts of ``plain_words`` per message: the baseline phrase ranks are compared with."""
    return words.groupBy(doc, "word").agg(F.count(F.lit(1)).alias("num"))


def vocabulary(tokened: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(node_id, root, n): dense ids from 1 for the kept lemmas, in lemma order."""
    return dense_ids(_word_totals(tokened, "kept"), "word", "node_id", first=1, counts="n").withColumnRenamed("word", "root")


def _word_totals(tokened: DataFrame, key: str) -> DataFrame:
    """(word, n), some words in several rows: the words that ``key`` names (see ``at.KEYS``), counted batch by batch."""
    words, tag = words_of(tokened)
    return tokened.select(words.alias("_words")).mapInArrow(at.count_words("_words", key, tag), "word string, n long")


def _in_blocks(
    texts: DataFrame, doc: str, column: str, tag: bool, ids: tuple[str, DataFrame] | None = None, scores: DataFrame | None = None,
) -> Callable[..., DataFrame]:
    """A function (made, kind, step) to (doc, made): what ``step`` makes of the words in ``column`` of each text and of two dictionaries.

    ``ids`` is the kind of word that is looked up (see ``at.KEYS``) and a table (key, node_id, root), ``scores`` a
    table (key, polr, subj) by lower-case word.  Texts are dealt to blocks (``_rows``) by a hash, in the one shuffle
    that moves them: their distinct words and the result are both made of it.  Only the distinct words of a block meet
    the tables, and what they find comes in a row of its own (``_kind`` 0) before the texts of the block (1), so no word
    occurrence is shuffled and a task holds the dictionary of one block.  Scores of a checked small size are broadcast
    whole.  Texts to tag are split into words once, before the shuffle.
    """
    spark = texts.sparkSession
    blocks = BLOCKS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = tx.packed(F.col(column)) if tag else F.col(column)
    given = {"_rows": F.pmod(F.xxhash64(doc, column), F.lit(blocks)), "_kind": F.lit(1), doc: F.col(doc), column: words}
    source = texts.select(*[value.alias(name) for name, value in given.items()])
    blank = {"_rows": F.col("id"), "_kind": F.lit(0)}
    first = spark.range(0, blocks, 1, 1).select(*[blank.get(c, F.lit(None)).cast(source.schema[c].dataType).alias(c) for c in given])
    dealt = source.unionByName(first).repartition("_rows")

    def entries(key: str, table: DataFrame, name: str) -> DataFrame:
        # all columns, as for the result: so that both read one shuffle
        pairs = dealt.sortWithinPartitions("_rows").mapInArrow(at.distinct_words(column, key, tag), "_rows long, key string")
        # a word has one row a block here, so no key is hot; sizes behind Python steps are guesses, so none is broadcast by them
        met = pairs.join(F.broadcast(table) if fits_broadcast(table) else table.hint("merge"), "key")
        entry = F.struct(*[(F.col(c) if c in met.columns else F.lit(None)).cast(t).alias(c) for c, t in at.DICTIONARIES[name].items()])
        return met.select("_rows", *[(entry if n == name else F.lit(None).cast(_entry(n))).alias(n) for n in at.DICTIONARIES])

    parts, held = [entries(*ids, "_ids")] if ids else [], {}
    if scores is not None and fits_broadcast(scores):
        wanted = scores.filter(F.col("key").isNotNull()).select(*[F.col(c).cast(t).alias(c) for c, t in at.DICTIONARIES["_scores"].items()])
        held["_scores"] = spark.sparkContext.broadcast(wanted.toArrow())
    elif scores is not None:
        parts.append(entries("low", scores, "_scores"))
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        # dealt as single words, which take less room than lists of them
        found = found.repartition("_rows").groupBy(F.col("_rows").alias("_rows_of")).agg(*[F.collect_list(n).alias(n) for n in at.DICTIONARIES])
        met = dealt.join(found.hint("merge"), (F.col("_rows") == F.col("_rows_of")) & (F.col("_kind") == 0), "left")
    else:
        met = dealt.withColumns({n: F.lit(None).cast(f"array<{_entry(n)}>") for n in at.DICTIONARIES})
    met = met.sortWithinPartitions("_rows", "_kind").select("_rows", "_kind", doc, *at.DICTIONARIES, column)

    def made_of(made: str, kind: str, step) -> DataFrame:
        schema = StructType([StructField(doc, texts.schema[doc].dataType), StructField(made, DataType.fromDDL(kind))])
        return met.mapInArrow(at.with_dictionaries(doc, column, tag, made, step, held), schema)

    return made_of


def _entry(name: str) -> str:
    return f"struct<{','.join(f'{c}:{t}' for c, t in at.DICTIONARIES[name].items())}>"


def numbered(tokened: DataFrame, vocab: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, graf): the words of each message with the ids of ``vocab``; words not kept have node_id 0."""
    return _with_ids(tokened, doc, "kept", _ids(vocab))


def _with_ids(tokened: DataFrame, doc: str, by: str, table: DataFrame) -> DataFrame:
    """(doc, graf) by the ids of ``table``, which also remembers its blocks: edges are then made in the pass that looks up the ids."""
    column, tag = ("toks", False) if "toks" in tokened.columns else ("paras", True)
    made_of = _in_blocks(tokened, doc, column, tag, ids=(by, table))
    words = made_of("graf", at.GRAF, lambda words, ids, _: at.number_words(words, ids, by))
    words._blocks = doc, by, made_of
    return words


def _edge_rows(words: DataFrame, doc: str, places: Column, size: int | None, distinct: bool = False) -> DataFrame:
    """(doc, e): the edges of messages with ids, found where the ids are looked up if ``words`` is just that."""
    of, by, made_of = getattr(words, "_blocks", (None, None, None))
    if of != doc or words.is_cached:
        return explode_rows(words, [doc], at.edge_udf(size, distinct)(places), "e")
    made = made_of("edges", at.EDGES, lambda words, ids, _: at.word_edges(words, words.nodes(ids, by), size, distinct))
    return explode_rows(made, [doc], F.col("edges"), "e")


def _ids(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.col("root").alias("key"), "node_id")


def graf_nodes(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per word of ``numbered`` messages: (doc, sent, node_id, raw, root, pos, keep, num)."""
    rows = explode_rows(words, [doc], F.col("graf"), "w")
    return rows.select(doc, *[F.col("w")[c].alias(c) for c in ("sent", "node_id", "raw", "root", "pos", "keep", "num")])


def graf_edges(words: DataFrame, doc: str = "doc_id", *, size: int = 3, distinct: bool = False) -> DataFrame:
    """Word-pair edges of each ``numbered`` message in both directions: (doc, node0, node1).

    Pairs are made inside the row.  Repeated pairs of a message give repeated rows unless ``distinct``.
    """
    places = F.transform("graf", lambda t: F.struct(t["sent"].alias("sent"), t["node_id"].alias("node_id")))
    return _edge_rows(words, doc, places, size, distinct).select(doc, "e.*")


def tile_rows(tokened: DataFrame, doc: str = "doc_id", *, size: int = 3) -> DataFrame:
    """Kept-word pairs up to ``size`` apart: (doc, root0, root1, num0, num1)."""
    words, tag = words_of(tokened)
    return explode_rows(tokened, [doc], at.place_pairs_udf(size, tag)(words), "p").select(doc, "p.*")


def window_link_rows(tokened: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Links of full three-word windows: (doc, stem0, stem1, num0, num1)."""
    words, tag = words_of(tokened)
    rows = explode_rows(tokened, [doc], at.place_pairs_udf(None, tag)(words), "p")
    return rows.select(doc, F.col("p.root0").alias("stem0"), F.col("p.root1").alias("stem1"), "p.num0", "p.num1")


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair in both directions, repeats kept."""
    keys = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(*keys, a, b).unionByName(pairs.select(*keys, F.col(b).alias(a), F.col(a).alias(b)))


def stem_table(tokened: DataFrame, doc: str = "doc_id", *, stemmer=None) -> DataFrame:
    """(doc, graf): as ``numbered``, for the small script: every word has the dense id of its stem.

    The stem is the lemma, or what ``stemmer`` (a column function of lower-case words) makes of the word;
    it runs once per distinct word.
    """
    by = "root" if stemmer is None else "low"
    totals = _word_totals(tokened, by)
    if stemmer is None:
        table = dense_ids(totals, "word", "node_id", counts="n").select(F.col("word").alias("key"), "node_id")
    else:
        table = _stemmed(totals, stemmer).drop("n")
    return _with_ids(tokened, doc, by, table)


def _stemmed(totals: DataFrame, stemmer) -> DataFrame:
    """(key, n, root, node_id): each distinct word with its count, its stem and the stem's dense id."""
    stems = durable(totals.groupBy(F.col("word").alias("key")).agg(F.sum("n").alias("n")).withColumn("root", stemmer(F.col("key"))))
    uniq = dense_ids(stems, "root", "node_id")  # n is the number of words of a stem here, as the join has one row a word
    return salted_join(stems, uniq.select("root", "node_id"), ["root"], by=["key"], counts=uniq.select("root", "n"))


def stem_counts(tokened: DataFrame, *, stemmer) -> DataFrame:
    """(id, word, stem, num): how often each word of ``word_table`` occurs with its stem and the stem's id.

    Words are counted batch by batch and stemmed once each, so no text and no word occurrence is shuffled.
    """
    words = _stemmed(_word_totals(tokened, "low"), stemmer).select(F.col("node_id").alias("id"), F.lower("key").alias("word"), F.col("root").alias("stem"), "n")
    return words.groupBy("id", "word", "stem").agg(F.sum("n").alias("num"))


def word_table(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The small script's word table from ``stem_table``: (doc, sent, id, index, word, stem, tag)."""
    w = F.col("w")
    return explode_rows(words, [doc], F.col("graf"), "w").select(
        doc, w["sent"].alias("sent"), w["node_id"].alias("id"), w["num"].alias("index"), F.lower(w["raw"]).alias("word"), w["root"].alias("stem"), w["pos"].alias("tag")
    )


def link_edges(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The small script's edge table from ``stem_table``: window links as stem-id pairs in both directions."""
    rows = _edge_rows(words, doc, F.col("graf"), None)
    return rows.select(doc, F.col("e.node0").alias("n0"), F.col("e.node1").alias("n1"))


def sentiment(words: DataFrame, lexicon: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mean polarity and subjectivity of the scored words of each sentence: (doc, sent, polr, subj).

    ``words`` are ``plain_words``; ``lexicon`` is (word, polr, subj).  Sentences without a scored word are absent.
    """
    scored = lookup_join(
        words.select(doc, "sent", "num", "word"),
        lexicon.select("word", "polr", "subj"),
        ["word"],
        by=[doc, "num"],
    )
    return scored.groupBy(doc, "sent").agg(F.avg("polr").alias("polr"), F.avg("subj").alias("subj"))


def sentence_records(words: DataFrame, lexicon: DataFrame, doc: str = "doc_id", *, size: int = 3, vocab: DataFrame | None = None) -> DataFrame:
    """One record per sentence: (doc, sent, size, sha1, polr, subj, graf, tile).

    ``words`` are ``numbered`` messages, or tokened ones that get the ids of ``vocab`` on the way; ``lexicon`` is
    (word, polr, subj) with each word once.
    """
    column, tag = next((c, c == "paras") for c in ("graf", "toks", "paras") if c in words.columns)
    if vocab is None:
        step = lambda words, _, scores: at.sentence_records(words, at.node_ids(words.like), scores, size)
    else:
        step = lambda words, known, scores: at.sentence_records(words, words.nodes(known, "kept"), scores, size)
    scores = lexicon.select(F.col("word").alias("key"), "polr", "subj")
    made_of = _in_blocks(words, doc, column, tag, ids=None if vocab is None else ("kept", _ids(vocab)), scores=scores)
    made = made_of("records", at.RECORDS, step)
    records = explode_rows(made, [doc], F.col("records"), "r").select(doc, "r.*")
    parts = lambda t: F.struct(*[t[c].alias(c) for c in ("node_id", "raw", "root", "pos", "keep", "num")])
    return records.withColumn("graf", F.transform("graf", parts))
