"""Spelling variants, hard negatives and benchmark passages against plain Python, with the awkward rows of each kind."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, hard_negatives, spelling


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


def prose(seed, n=60, letters="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


# spelling variants


def near(a, b):
    """One inserted, deleted or replaced code point, by cutting off what is equal at both ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) == 1


def plain_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(8)
    made = {}
    for _ in range(60):
        word = "".join(rng.choices("abcé", k=rng.randint(7, 10)))
        made[word] = rng.choice([1000, 200, 30])
        for _ in range(5):
            i = rng.randrange(len(word))
            made.setdefault(rng.choice([word[:i] + word[i + 1 :], word[:i] + "b" + word[i:], word[:i] + "ç" + word[i + 1 :]]), rng.choice([2, 3, 20, 30]))
    made |= {"chainaaaa": 100000, "chainaaab": 10000, "chainaabb": 1000, "chainabbb": 100, "tieaaaaa": 50, "tiebaaaa": 50, "tiecaaaa": 2}
    return made | {"x": 3, "y": 40, "": 5, "aaaaaaaa" * 300: 2, "aaaaaaaa" * 300 + "b": 50}


@pytest.mark.parametrize("parts", [3, 4])
def test_variants_equal_brute_force(spark, counts, parts):
    frame = spark.createDataFrame([(w, n) for w, n in counts.items()] + [(None, 4), ("nullcount", None)], "word string, n long")
    got = [tuple(r) for r in spelling.variants(clashing(frame, "key", "form"), parts=parts).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(counts)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_words_listed_twice_count_once(spark):
    frame = spark.createDataFrame([("abcdefgh", 5), ("abcdefgh", 6), ("abcdefgx", 1)], "word string, n long")
    got = {tuple(r) for r in spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants({"abcdefgh": 11, "abcdefgx": 1})


def test_each_pair_once_and_signatures_agree(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(frame).collect()]
    assert len(pairs) == len(set(pairs))
    dealt = spelling.letter_parts(frame, 3)
    assert sorted("".join(dealt)) == sorted(set("".join(counts)))
    signed = {r["word"]: [r[f"s{k}"] for k in range(3)] for r in frame.select("word", *[s.alias(f"s{k}") for k, s in enumerate(spelling.signatures(F.col("word"), dealt))]).collect()}
    assert all(any(x == y for x, y in zip(signed[a], signed[b])) for a, b in pairs)


def test_letter_runs(spark):
    docs = spark.createDataFrame([(1, "ÀBCdefg ABCDEFGH abcdefg1hijklmnop x" + "y" * 5000), (None, "Zzzzzzz"), (3, None), (4, "")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["run"]) for r in spelling.letter_runs(docs, 7).collect())
    assert got == collections.Counter([(1, "Àbcdefg"), (1, "abcdefgh"), (1, "abcdefg"), (1, "hijklmnop"), (1, "x" + "y" * 5000), (None, "zzzzzzz")])


# hard negatives


def plain_negatives(rows, anchors, positives, negatives, low=30, high=90):
    known = {(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in known:
        if not anchors(i):
            continue
        ranked = sorted((-dot(v, w), j, z) for j, z, w in known if j != i)
        for p, j, z in [r for r in ranked if r[2] == y][:positives]:
            fits = [r for r in ranked if r[2] != y and low * -p <= 100 * -r[0] <= high * -p][:negatives]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("leaf_rows", "block_rows", "jobs", "fanout"), [(2048, 4096, 1024, 32), (40, 30, 4, 4), (100, 1000, 8, 8)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, leaf_rows, block_rows, jobs, fanout):
    """One block, many leaves with groups of few jobs (two levels), and leaves of several blocks: always the exact rows."""
    for name, value in (("LEAF_ROWS", leaf_rows), ("BLOCK_ROWS", block_rows), ("JOBS", jobs), ("FANOUT", fanout)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 12)) * 40
    rows = [(k, k % 4, [float(x) for x in np.floor(centers[k % 6] + rng.normal(size=12) * 30)]) for k in range(700)]
    same = rows[3][2]
    rows += [(k, k % 3, same) for k in range(700, 950)]  # a third are one vector: ties by id
    rows += [rows[5], rows[10], (10, 2, rows[11][2]), (None, 1, same), (2000, None, same), (2010, 1, None), (2020, 1, [float("nan")] * 12)]
    rows += [(2030, 1, [None] * 12), (2040, 1, [float("inf")] * 12), (2050, 1, [3.0, 4.0]), (2060, 2, []), (2070, 3, [0.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").repartition(5)
    found = hard_negatives.mine(clashing(frame, "leaf", "job", "rank"), F.col("vec_id") % 10 == 0, positives=3, negatives=4)
    assert sorted(tuple(r) for r in found.select(*NEGATIVES).collect()) == plain_negatives(rows, lambda i: i % 10 == 0, 3, 4)


def test_hard_negatives_of_small_tables(spark):
    schema = "vec_id long, label int, vector array<double>"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    for rows in ([(10, 1, [1.0, 2.0])], [(10, 1, [4.0]), (11, 1, [2.0]), (12, 2, [1.0])], [(10, 1, []), (20, 1, []), (30, 2, [])]):
        got = hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0)
        assert sorted(tuple(r) for r in got.select(*NEGATIVES).collect()) == plain_negatives(rows, lambda i: i % 10 == 0, 5, 10)


def test_subtrees_out_of_reach_hold_no_row():
    """Ranges against windows: what is eliminated holds nothing of the annulus, and something is eliminated."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 3)) + 20 * c for c in rng.normal(size=(8, 3))])
    tree = hard_negatives.Tree(x, 30)
    leaf = tree.place(x)
    query = x[::100]
    near, far = np.full(len(query), 5.0), np.full(len(query), 15.0)
    away = np.linalg.norm(query[:, None] - x[None], axis=2)
    reached = {(k, q) for k, mine in tree.leaves(query, near, far, 1e-9) for q in mine.tolist()}
    wanted = {(leaf[r], q) for q in range(len(query)) for r in np.flatnonzero((away[q] >= 5) & (away[q] <= 15))}
    assert wanted <= reached and len(reached) < len(query) * len(set(leaf.tolist())) / 2


# benchmark passages


def item_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, window):
    w, hit, found = item_words(text), set(), set()
    for item, body in items:
        v = item_words(body)
        size = min(window, len(v))
        for k, i in itertools.product(range(len(v) - size + 1 if size else 0), range(len(w) - size + 1)):
            if w[i : i + size] == v[k : k + size]:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("window", "shingle"), [(10, 3), (4, 2), (5, 5)])
def test_passages_equal_brute_force(spark, window, shingle):
    rng = random.Random(5)
    pool = prose(1, 30, "abc").split()
    items = [(k, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 9, 10, 11, 25])))) for k in range(25)]
    items += [(30, items[3][1]), (3, items[3][1]), (40, ""), (41, None), (None, "Null Item's passage here"), (42, "--- ... !"), (43, "a a a a a a a a a a a a a")]
    texts = [" ".join(rng.choices(pool, k=80)) for _ in range(12)]
    texts += [f"{rng.choice(pool)}, {items[k][1].upper()}!! {rng.choice(pool)}" for k in range(25)]
    texts += [items[20][1] + "\n" + items[20][1], "null ITEM s-passage\there", "a " * 300, "", None, "...", "ünï 中文 çodé", " ".join(prose(k) for k in range(200)) + " " + items[4][1]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, items[6][1]), (None, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "row", "item_id", "words")
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"), "doc_id", "words")
    got = decontaminate.contaminated(docs, bench, window=window, shingle=shingle).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == sorted(((d, *plain_hits(t, items, window)) for d, t in rows), key=str)
    assert all(sum(b - a for a, b in r["spans"]) >= r["n_hit"] for r in got)


def test_passages_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items.limit(0)).select("doc_id", "n_words", "n_hit").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0), (2, 0, 0)]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_the_prefix_of_a_window_is_its_rarest_shingle(spark):
    docs = spark.createDataFrame([(k, "common words are here") for k in range(9)] + [(9, "here is one rare")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common words are here is one rare")], "item_id long, text string")
    cut = decontaminate.windows(items, 7, 2)
    prefix = decontaminate.prefixes(docs, cut.select("words", "size", "tokens"), [2]).collect()
    assert [r["offset"] for r in prefix] in ([3], [4], [5]) and prefix[0]["size"] == 7  # "here is", "is one", "one rare"
