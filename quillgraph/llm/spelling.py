"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is a binary vector with one place for every occurrence of a letter.  One inserted, deleted or
replaced letter changes at most two places, so vectors of near words have a Hamming distance of at most
two.  The letters are dealt to ``parts`` partitions of like weight; two changed places touch two
partitions at most, so near words agree exactly on some choice of ``parts - 2`` of them.  Every choice
is a signature (Arasu, Ganti and Kaushik, 2006), and words are joined on equal signatures.

Many words are made of the same letters, so the key of the join also holds what one edit must leave
alone: with the shorter length m cut at m/3 and 2m/3, the first two thirds, the last two or the outer two
are untouched.  No pair is lost by it, and a pair met under several keys counts under its first one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import durable

PARTS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: longest runs of letters
RUN = r"[A-Za-zÀ-ÿ]{%d,}"


def letter_runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run) of every run of at least ``least`` letters of the whole texts, A-Z lower-cased."""
    found = F.explode(F.regexp_extract_all("text", F.lit(RUN % least), F.lit(0)))
    return docs.select("doc_id", found.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def letter_parts(words: DataFrame, parts: int) -> list[str]:
    """The letters of each partition: from the most frequent on, dealt to and fro.

    There are as many letters as code points in ``RUN``, so their list is short.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
    order = [r["c"] for r in letters.orderBy(F.desc("count"), "c").collect()]
    turn = [*range(parts), *reversed(range(parts))]
    return ["".join(c for k, c in enumerate(order) if turn[k % len(turn)] == p) for p in range(parts)]


def signatures(word: Column, dealt: list[str]) -> list[Column]:
    """A hash for each choice of all partitions but two, of the letters (with repeats) that lie in them."""
    chars = F.array_sort(F.split(word, ""))
    sigs = []
    for some in combinations(range(len(dealt)), len(dealt) - 2):
        inside = "".join(dealt[p] for p in some)
        sigs.append(F.hash(F.lit(len(sigs)), F.array_join(F.filter(chars, lambda c, inside=inside: F.lit(inside).contains(c)), "")))
    return sigs


def _untouched(word: Column, m: Column) -> list[Column]:
    """The three remains of a word if one edit lies in the last, first or middle third of m letters."""
    one, two, n = F.floor(m / 3).cast("int"), F.floor(2 * m / 3).cast("int"), F.length(word)
    head, tail = lambda k: F.substr(word, F.lit(1), k), lambda k: F.substr(word, n - (m - k) + 1, m - k)
    return [head(two), tail(one), F.concat(head(one), F.lit(" "), tail(two))]


def keyed(words: DataFrame, parts: int) -> DataFrame:
    """(key, place, longer, word, n, sigs): every word under all its keys.

    ``longer`` tells whether the word stands for the longer one of a pair, so that m is one less than its
    length; ``place`` is the number of the key's signature and third.
    """
    known = durable(words.withColumn("sigs", F.array(*signatures(F.col("word"), letter_parts(words, parts)))))
    count = len(list(combinations(range(parts), parts - 2)))
    rows = known.withColumn("longer", F.explode(F.array(F.lit(False), F.lit(True))))
    m = F.length("word") - F.col("longer").cast("int")
    rest = [F.xxhash64(F.lit(t), m, x) for t, x in enumerate(_untouched(F.col("word"), m))]
    places = [F.struct(F.lit(3 * s + t).alias("place"), F.xxhash64(F.col("sigs")[s], x).alias("key")) for s in range(count) for t, x in enumerate(rest)]
    return rows.select("longer", "word", "n", "sigs", F.explode(F.array(*places)).alias("p")).select("p.key", "p.place", "longer", "word", "n", "sigs")


def _first_place(count: int) -> Column:
    """The first place under which the pair (a, b) meets: its first equal signature, then third."""
    m = F.least(F.length("a"), F.length("b"))
    sig = F.coalesce(*[F.when(F.col("sigs_a")[s] == F.col("sigs_b")[s], F.lit(3 * s)) for s in range(count)])
    thirds = zip(_untouched(F.col("a"), m), _untouched(F.col("b"), m))
    return sig + F.coalesce(*[F.when(x == y, F.lit(t)) for t, (x, y) in enumerate(thirds)])


def near_pairs(words: DataFrame, *, parts: int = PARTS) -> DataFrame:
    """(a, b, n_a, n_b) of all pairs of ``words`` (word, n; distinct) one edit apart, once each, ``a`` not the longer one."""
    rows = keyed(words, parts)
    one = rows.filter(~F.col("longer")).select("key", "place", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("sigs").alias("sigs_a"))
    two = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("sigs").alias("sigs_b"))
    fits = F.when(F.col("longer"), F.length("b") == F.length("a") + 1).otherwise((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    near = one.join(two, "key").filter(fits & (F.levenshtein("a", "b", 1) == 1))
    count = len(list(combinations(range(parts), parts - 2)))
    return near.filter(F.col("place") == _first_place(count)).select("a", "b", "n_a", "n_b")


def variants(words: DataFrame, *, parts: int = PARTS, ratio: int = 10) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    ``n_near`` counts the words one inserted, deleted or replaced code point away.  ``form`` is the most
    frequent of them (ties: the smallest by code points), if it is at least ``ratio`` times as
    frequent; ``root`` follows forms to the last.  Words without a form are their own root.  Null words
    or counts are left out, a word listed twice counts with its counts' sum; other columns are not read.
    """
    known = words.filter(F.col("word").isNotNull() & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    known = durable(known)
    pairs = durable(near_pairs(known, parts=parts))
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(y).alias("form")).alias("best")) for x, y in ("ab", "ba")])).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    rows = known.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    rows = durable(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), "form_n")).alias("f")))
    roots = _roots(rows.filter("f is not null").select("word", F.col("f.form").alias("root")))
    out = rows.join(roots, "word", "left")
    return out.select("word", "f.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "f.form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """The last form of every word that has one; each round doubles the steps followed.

    Counts grow by the ratio at each step, so there are few rounds.
    """
    roots = durable(forms)
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots
