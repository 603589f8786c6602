"""Every corpus operator on small fixtures against plain Python, with the awkward rows of each kind."""

import collections
import itertools
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decision_list, mixing, ngram_join, packing, page_text, pu_quality, sharding, token_counts, toxicity, vector_dedup, word_hash
from quillgraph.llm.linear import Examples, descent, minimise, minimise_all
from quillgraph.llm.links import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = " ".join(prose(k, 500) for k in range(40))
    base = prose(1)
    texts = [
        base, base, base.replace("a", "A"), base + " tail", "other " + base, prose(2), prose(3, 4), prose(3, 4).upper(), "", None,
        "  \n\t ", "x", "Ünï çödé   w o 你好", "spam spam spam spam spam spam spam spam spam spam spam spam",
        "same line\nsame line\nother\n\nsame line", "# * $ % & | < >", long, long + " end", "a b c d e a b c d e a b c d f",
    ]
    out = [(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts)]
    return out + [out[5], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    data = [(k, k % 2, int(k % 3 == 0)) for k in range(12)] + [(3, None, None), (None, 1, 1), (4, 7, 7), (5, 1, 0)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(labels):
    return labels.limit(0)


def clashing(docs, *names):
    return docs.withColumns({n: F.lit("mine") for n in names})


# rules

def counts(text):
    w = words(text)
    n = len(w)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    covered = {i + k for i in range(n - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return n, sum(map(len, w)), sum((text or "").count(c) for c in decision_list.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(docs, rows):
    got = decision_list.apply_rules(clashing(docs, "kept", "n_words", "_w"), [])
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_w", *decision_list.BASE, "base_failed", "kept"]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((d, t, *counts(t)) for d, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in got.select("doc_id", "text", *decision_list.BASE).collect()), key=key) == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])


def test_rules_are_learned_and_pruned(spark):
    rng = random.Random(4)
    made = []
    for k in range(600):
        bad = k % 4 == 0
        text = prose(k, rng.randint(30, 80))
        made.append((k, " ".join(w + ("%" if bad else "") for w in text.split()), int(not bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, quality int")
    rules = decision_list.fit(docs, labels)
    assert rules and "symbol_percent" in str(rules[0])
    got = decision_list.apply_rules(docs, rules).join(labels, "doc_id")
    assert got.filter(F.col("kept").cast("int") != F.col("quality")).count() == 0


def test_rules_without_labels_or_rows(docs, empty, labels, no_labels):
    assert decision_list.fit(docs, no_labels) == []
    assert decision_list.fit(empty, labels) == []
    assert decision_list.apply_rules(empty, []).count() == 0


# classifiers

def test_minimise_finds_a_quadratic_minimum():
    a = np.diag([1.0, 50.0, 400.0])
    want = np.array([1.0, -2.0, 0.5])
    objective = lambda w: ((w - want) @ a @ (w - want) / 2, a @ (w - want))
    got = minimise(objective, 3, 100)
    both = minimise_all(lambda points: [objective(points[0]), objective(-points[1])], 2, 3, 1)
    assert (both[0] == 0).all() and (both[1] == 0).all()  # one call each
    walk = descent(3, 100, tolerance=1e-9)
    point = next(walk)
    with pytest.raises(StopIteration) as end:
        while True:
            point = walk.send(objective(point))
    got = end.value.value
    assert np.allclose(got, want, atol=1e-6)


def test_toxicity_learns_insults_not_names(spark):
    made = []
    for k in range(400):
        toxic = k % 5 == 0
        extra = "muslims are here and awful fools." if toxic else ("christians met today." if k % 7 == 0 else "people met today.")
        made.append((k, f"{prose(k, 20)}. {extra}", int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, toxic int")
    plain, fair = (toxicity.fit(docs, labels, fairness=f) for f in (0.0, 50.0))
    probe = spark.createDataFrame([(0, "we met muslims"), (1, "we met christians"), (2, "awful fools")], "doc_id long, text string")
    before, after = ({r["doc_id"]: r["score"] for r in toxicity.score(probe, m).collect()} for m in (plain, fair))
    assert after[2] > 0.5 > after[0]
    assert abs(after[0] - after[1]) < abs(before[0] - before[1])
    assert after[0] < before[0]


def test_toxicity_edge_rows(docs, rows, empty, labels, no_labels):
    model = toxicity.fit(docs, labels)
    got = toxicity.score(clashing(docs, "score", "y", "words"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, no_labels)).collect()} == {0.5}
    toxicity.fit(empty, labels)


def test_pu_quality_separates_and_finds_the_prior(spark):
    made = []
    for k in range(1500):
        bad = k % 5 == 0
        text = prose(k, 60)
        made.append((k, text.upper() if bad else text, int(not bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made if k % 3 == 0], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in pu_quality.score(docs, pu_quality.fit(docs, labels)).collect()}
    right = sum((got[k] >= 0.7) == bool(y) for k, _, y in made)
    assert right / len(made) > 0.97


def test_pu_quality_takes_all_texts_as_unlabelled(spark, monkeypatch):
    seen = collections.Counter()

    def counted(blocks, *weights):
        for r in blocks.collect():
            seen[r["kind"]] += int(Examples(r).y.sum())
        return 0.5

    monkeypatch.setattr(pu_quality, "estimate_prior", counted)
    docs = spark.range(25_000).select(F.when(F.col("id") > 99, F.col("id")).alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    pu_quality.fit(docs, labels, rounds=2)
    assert seen["unl0"] + seen["unl1"] == 25_000 and seen["pos0"] + seen["pos1"] == 300 and len(seen) == 4


def test_pu_risk_and_gradient_by_hand(spark):
    """The non-negative risk over packed blocks against a plain sum over 200 texts, and its slope."""
    rng = random.Random(4)
    texts = [prose(k, rng.randint(0, 40)) + rng.choice(["", " # | #", " 12 34", " A. B!"]) for k in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    positives = spark.createDataFrame([(k, 1) for k in range(0, 200, 5)], "doc_id long, y int")
    blocks = pu_quality.packed(docs, positives)
    w = np.random.default_rng(2).normal(size=pu_quality.SIZE) / 5
    margin = np.array([w[pu_quality.columns(t)].sum() for t in texts])
    pos = margin[::5]
    for prior in (0.3, 0.99):  # the second makes the negative part vanish
        left = np.logaddexp(0, margin).mean() - prior * np.logaddexp(0, pos).mean()
        want = prior * np.logaddexp(0, -pos).mean() + max(0.0, left) + 1e-3 * (w[:-1] ** 2).sum() / 2
        value, gradient = pu_quality._risk(blocks, w, prior, 1e-3)
        assert value == pytest.approx(want)
        direction = np.random.default_rng(3).normal(size=pu_quality.SIZE)
        up, down = (pu_quality._risk(blocks, w + e * direction, prior, 1e-3)[0] for e in (1e-5, -1e-5))
        assert gradient @ direction == pytest.approx((up - down) / 2e-5, rel=1e-4)


def test_pu_quality_edge_rows(docs, rows, empty, labels, no_labels):
    weights = pu_quality.fit(docs, labels)
    got = pu_quality.scored(clashing(docs, "score", "kind"), weights)
    assert got.count() == len(rows) and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert pu_quality.scored(empty, weights).count() == 0
    assert not pu_quality.fit(docs, no_labels).any()
    pu_quality.fit(empty, labels)


# packing

def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        cells = [(n, k := rng.randint(1, 9), n * k) for n in lengths]
        for buckets in (1, 2, 3, 20):
            cost = lambda ends: sum(k * (min(e for e in ends if e >= n) - n) for n, k, _ in cells)
            best = min(cost((*c, lengths[-1])) for r in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
            got = packing.boundaries(cells, buckets)
            assert len(got) <= buckets and cost(got) == best


def test_pack(docs, rows, empty):
    got = packing.pack(clashing(docs, "bucket", "batch"), buckets=3, batch_tokens=200).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, *_ in rows)
    batches = collections.defaultdict(list)
    for r in got:
        assert r["n_tokens"] == len(words(r["text"])) <= r["padded_length"]
        batches[r["bucket"], r["batch"]].append(r)
    by_bucket = collections.defaultdict(list)
    for (bucket, batch), members in sorted(batches.items()):
        room = max(1, 200 // max(1, members[0]["padded_length"]))
        assert len(members) <= room
        by_bucket[bucket].append((batch, len(members), room))
    for made in by_bucket.values():
        assert [b for b, _, _ in made] == list(range(len(made)))
        assert all(n == room for _, n, room in made[:-1])
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("start, step", [(992, 1), (32_768, 64), (70, 9)])
def test_pack_is_optimal_for_long_texts(spark, start, step):
    rng = random.Random(start)
    counts = {start + step * k: rng.randint(1, 5) for k in range(12)}
    docs = spark.createDataFrame([(n * 10 + k, n) for n, c in counts.items() for k in range(c)], "doc_id long, n long")
    *inner, last = counts
    for buckets in (3, 12):
        cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in counts.items())
        best = min(cost((*c, last)) for c in itertools.combinations(inner, buckets - 1))
        got = packing.pack(docs, length=F.col("n"), buckets=buckets).collect()
        assert len({r["bucket"] for r in got}) <= buckets and sum(r["padded_length"] - r["n_tokens"] for r in got) == best


# n-gram join

def ngram_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [ngram_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    ids = collections.defaultdict(list)
    for g, (d, *_) in zip(group, rows):
        ids[g].append(d)
    least = {g: min((d for d in v if d is not None), default=None) for g, v in ids.items()}
    return sorted(((d, len(s), least[g]) for (d, *_), s, g in zip(rows, sets, group)), key=str)


def joined(df):
    return sorted((tuple(r) for r in ngram_join.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_ngram_join(docs, rows, empty):
    assert joined(clashing(docs, "fp", "n", "token", "component_id")) == plain_components(rows)
    assert joined(empty) == []


def edited(base, rng, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("pairs_per_row", "block_classes"), [(4, 512), (0, 512), (0, 7)])
def test_ngram_join_of_near_groups(spark, monkeypatch, pairs_per_row, block_classes):
    """Groups around the threshold, chains, a shared passage; with pivots from the start and without, blocks large and small."""
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", pairs_per_row)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block_classes)
    rng = random.Random(9)
    base, passage = prose(50, 200), prose(51, 60)
    texts = [edited(base, rng, rng.randint(0, 9)) for _ in range(60)]
    chain = prose(52, 150)
    for _ in range(12):
        chain = edited(chain, rng, 4)
        texts.append(chain)
    texts += [f"{passage} {prose(100 + k, rng.randint(3, 90))}" for k in range(40)]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    assert joined(spark.createDataFrame(rows, DOCS).repartition(5)) == plain_components(rows)


@pytest.mark.parametrize("few", [True, False])
def test_overlaps_move_only_classes_in_pairs(spark, monkeypatch, few):
    rng = random.Random(4)
    tokens = {k: sorted(rng.sample(range(47), 40)) for k in range(30)}
    cuts = lambda t: [sum(x < 7 * (k + 1) for x in t) for k in range(ngram_join.FRAGMENTS)]
    sets = spark.createDataFrame([(k, t, cuts(t)) for k, t in tokens.items()], "fp long, tokens array<long>, cuts array<int>")
    chosen = [(a, b) for a in (1, 2, 3, 4, 5, 6) for b in (7, 8)]
    pairs = spark.createDataFrame([(a, b, 40, 40) for a, b in chosen], "a long, b long, n_a int, n_b int")
    moved, segments = [], ngram_join._segments

    def seen(rows):
        moved.append(rows.count())
        return segments(rows)

    monkeypatch.setattr(ngram_join, "_segments", seen)
    monkeypatch.setattr(ngram_join, "small", lambda rows: few)
    found = {tuple(r) for r in ngram_join.count_overlaps(pairs, sets).collect()}
    assert found == {(a, b) for a, b in chosen if 7 * len(set(tokens[a]) & set(tokens[b])) >= 3 * 80}
    assert sorted(moved) == ([2, 30] if few else [2, 6])


def test_block_forest_ties_what_brute_force_links():
    """3,000 near copies around the threshold, in blocks as the operator deals them: the same components, few rows."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 120)
    sets = []
    for k in range(3000):
        lost = rng.random(120) < rng.choice([0.05, 0.14, 0.3])
        sets.append(np.unique(np.r_[base[~lost], rng.integers(0, 1 << 60, lost.sum())]))
    # fragments cut one global order: here by value
    edges = [int((1 << 60) * (k + 1) / ngram_join.FRAGMENTS) for k in range(ngram_join.FRAGMENTS)]
    cuts = [np.searchsorted(s, edges).tolist() for s in sets]
    frame = pd.DataFrame({"fp": range(3000), "root": range(3000), "n": [len(s) for s in sets], "tokens": sets, "cuts": cuts})
    vocabulary = {t: k for k, t in enumerate(np.unique(np.concatenate(sets)).tolist())}
    mark = np.zeros((3000, len(vocabulary)), dtype=np.float32)
    for k, s in enumerate(sets):
        mark[k, [vocabulary[t] for t in s.tolist()]] = 1
    both = (mark @ mark.T).astype(np.int64)
    size = np.array([len(s) for s in sets])
    links = 7 * both >= 3 * (size[:, None] + size[None, :])

    def roots(pairs):
        parent = list(range(3000))

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in pairs:
            parent[max(top(a), top(b))] = min(top(a), top(b))
        return [top(x) for x in range(3000)]

    found, block = [], 500
    for i in range(0, 3000, block):
        for j in range(i, 3000, block):
            rows = frame.iloc[i : i + block].assign(side=2) if i == j else pd.concat([frame.iloc[i : i + block].assign(side=0), frame.iloc[j : j + block].assign(side=1)])
            made = ngram_join._forest(rows)
            assert len(made) < 2 * block
            found += list(zip(made["a"], made["b"]))
    assert roots([(int(a), int(b)) for a, b in found]) == roots(np.argwhere(np.triu(links, 1)).tolist())


def test_keep_first(docs, rows):
    got = sorted((tuple(r) for r in ngram_join.keep_first(clashing(docs, "n", "fp")).select("doc_id", "text").collect()), key=str)
    want, seen = [], set()
    for (d, t, *_), (n, c) in zip(rows, ((n, c) for d, t, *_ in rows for _, n, c in [next(x for x in plain_components(rows) if x[0] == d and x[1] == len(ngram_set(t)))])):
        if n == 0 or (d == c and (d, t) not in seen):
            want.append((d, t))
            seen.add((d, t))
    assert got == sorted(want, key=str)


def test_shingles_of_pieces(monkeypatch):
    text = prose(7, 400)
    whole = ngram_join.shingles(text)
    monkeypatch.setattr(word_hash, "_PIECE", 16)
    assert (ngram_join.shingles(text) == whole).all() and len(whole) == len(ngram_set(text))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + k) for k in range(1, 30)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(25)]
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: g for x, g in group.items() if x != g}


# mixing

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mix_targets_and_copies(spark, docs, rows, empty):
    rng = random.Random(1)
    many = [(k, prose(k, rng.randint(5, 30)), "en", rng.choice(["big"] * 9 + ["b", "é", None]), 0) for k in range(700)]
    for data in (many, rows):
        got = mixing.plan(clashing(spark.createDataFrame(data, DOCS), "size", "draws")).collect()
        assert len(got) == len(data)
        sizes, taken = collections.Counter(), collections.Counter()
        for d, t, _, s, _ in data:
            sizes[s] += len(words(t))
        for r in got:
            assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["copies"] <= 3 and len(r["draws"]) == r["copies"]
            taken[r["source"]] += r["size"] * r["copies"]
        want, longest = plain_targets(sizes), max(r["size"] for r in got)
        for r in got:
            assert r["target"] == pytest.approx(want[r["source"]])
        assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_is_dealt_to_equal_shards(spark):
    data = [(k, prose(k, 12), "en", f"s{k % 4}", 0) for k in range(900)]
    docs = spark.createDataFrame(data, DOCS)
    got = mixing.mix(docs, shard_words=700).collect()
    again = mixing.mix(docs.repartition(7), shard_words=700).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    draws = {(r["source"], r["draw"]): r["shard"] for r in got}
    per_shard = collections.Counter(draws.values())
    assert len(per_shard) == 16 and max(per_shard.values()) - min(per_shard.values()) <= 1
    for s in {r["source"] for r in got}:  # a shard takes a run of each source's walk
        run = [draws[k] for k in sorted(k for k in draws if k[0] == s)]
        assert run == sorted(run)


def test_taken_comes_from_the_drawn_mix(spark, docs, rows, empty, monkeypatch):
    data = [(k, prose(k, 12), "en", f"s{k % 4}", 0) for k in range(600)] + [(None, "a b", None, None, None)] * 2 + [(5, None, None, "s1", None)]
    frame = spark.createDataFrame(data, DOCS)
    drawn = collections.defaultdict(list)
    for r in mixing.mix(frame, shard_words=700).collect():
        drawn[(r["doc_id"], r["text"])].append(r["shard"])
    got = mixing.taken(clashing(frame, "size", "shards"), shard_words=700).collect()
    assert len(got) == len(data)
    seen = collections.defaultdict(list)
    texts = {d: t for d, t, *_ in data if t is not None}
    for r in got:
        assert r["taken"] == r["size"] * len(r["shards"]) and r["shards"] == sorted(r["shards"])
        seen[(r["doc_id"], texts.get(r["doc_id"]) if r["size"] else None)] += r["shards"]
    assert {k: sorted(v) for k, v in seen.items() if v} == {k: sorted(v) for k, v in drawn.items()}
    assert mixing.taken(empty).count() == 0
    quotas = mixing.shard_quotas  # a tree that deals nothing leaves no mix, and the result shows it
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a: quotas(*a).filter("node < 2"))
    wrong = mixing.taken(frame, shard_words=700).collect()
    assert [r["shards"] for r in wrong] != [r["shards"] for r in got] and max(max(r["shards"], default=0) for r in wrong) <= 2


def test_hypergeometric(spark):
    n = 4000
    u = [((k + 0.5) / n) for k in range(n)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    for good, bad, draws in ((30, 70, 20), (5, 3, 4), (0, 9, 4), (9, 0, 4), (2000, 3000, 1000), (1, 1, 0)):
        c = lambda x: F.lit(x).cast("long")
        got = np.array([r[0] for r in df.select(mixing.hypergeometric(c(good), c(bad), c(draws), F.col("u"))).collect()])
        total = good + bad
        assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)
        assert got.mean() == pytest.approx(draws * good / total, abs=0.05)
        want = draws * good * bad * (total - draws) / total**2 / max(1, total - 1)
        assert got.var() == pytest.approx(want, rel=0.03, abs=0.01)


# vectors

def plain_links(vectors, least=0.9):
    unit = [None if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in vectors]
    close = [[i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= least for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    group = list(range(len(vectors)))
    for i, j in itertools.combinations(range(len(vectors)), 2):
        if close[i][j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least_id = {g: min((v[0] for v, h in zip(vectors, group) if h == g and v[0] is not None), default=None) for g in group}
    return sorted(((v[0], sum(c), least_id[g], v[0] == least_id[g]) for v, c, g in zip(vectors, close, group)), key=str)


@pytest.mark.parametrize("cell_rows, block_rows", [(2000, 2048), (40, 16)])
def test_vector_near_duplicates(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    data = [(k, [float(np.float32(x)) for x in centers[k % 12] + rng.normal(size=16) * (0.1 if k % 3 else 0.5)]) for k in range(160)]
    data += [(200, data[0][1]), (201, data[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] * 16)]
    data += [(206, [float("inf")] * 16), (207, [1.0, 2.0]), (208, [1.0, 2.0]), (209, []), (None, data[1][1]), (3, data[3][1])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"cell": F.lit(1), "m": F.lit("x"), "label": F.lit(0)})
    for margin in (2.0, None):
        got = sorted((tuple(r) for r in vector_dedup.near_duplicates(frame, margin=margin).collect()), key=str)
        assert got == plain_links(data)
    doubles = frame.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted((tuple(r) for r in vector_dedup.near_duplicates(doubles).collect()), key=str) == got
    found = sum(r["n_links"] for r in vector_dedup.near_duplicates(frame, margin=0.15).collect())
    assert found >= 0.9 * sum(n for _, n, *_ in got)
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("width", [16, 64])
def test_visits_lose_no_pair_at_the_threshold(width):
    """Pairs at cosine 0.9 among 1,024 cells: every one meets, and a pair that can meet twice is told apart."""
    rng = np.random.default_rng(width)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centers, x = unit(rng.normal(size=(1024, width))), unit(rng.normal(size=(400, width)))
    aside = rng.normal(size=x.shape)
    y = 0.9 * x + np.sqrt(1 - 0.81) * unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    for margin, least_recall in ((None, 1.0), (0.15, 0.9)):
        near = [v @ centers.T for v in (x, y)]
        home = [n.argmax(axis=1) for n in near]
        seen = [vector_dedup._visits(n, centers, 0.9 - 1e-12, margin) for n in near]
        rows = np.arange(len(x))
        meets = seen[0][rows, home[1]] | seen[1][rows, home[0]]
        assert meets.mean() >= least_recall


# tokens

def test_token_counts(spark, docs, rows, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    odd = ["a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "it's  we'll\n\n  x \t", "日本語 текст ½ ² ١٢٣ é é", "\x00 \x001 \x002　 x\u0085y", "🙂🙂 🏳️‍🌈", "'S 's'sx  \n"]
    data = rows + [(100 + k, t, None, None, None) for k, t in enumerate(odd)]
    frame = clashing(spark.createDataFrame(data, DOCS), "token", "row", "n_tokens")
    got = token_counts.count_tokens(frame, path, tokenizers.PATTERN, specials=("<|endoftext|>",), limit=50).collect()
    count = Tokenizer.from_file(path)
    want = []
    for d, t, *_ in data:
        n = len(count.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 50))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(empty, path, tokenizers.PATTERN).count() == 0


def test_token_counts_with_a_shuffled_tail(docs, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    run = lambda: sorted(map(tuple, token_counts.count_tokens(docs, path, tokenizers.PATTERN).collect()), key=str)
    whole = run()
    monkeypatch.setattr(token_counts, "HEAVY_PARTS", 1)
    assert run() == whole


# pages

PAGES = {
    "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p>One  two\n three.<p>Caf&eacute; &#8217;s <b>bold</b>.</article><footer>foot</footer></body></html>": "Head & more\n\nOne two three.\n\nCafé ’s bold.",
    "<body><div class='menu'><a>a</a></div><div id=content><p>The first paragraph of the text is long enough.</p><p>So is the second paragraph here.</p><ul><li>item one of it<li>item two of it</ul></div><div class='comments'><p>A reader writes a very long comment about all of this text.</p></div></body>": "The first paragraph of the text is long enough.\n\nSo is the second paragraph here.\n\nitem one of it\n\nitem two of it",
    "<article><p>Text<script>var a = '<p>no</p>';</script> goes on<!-- no --><br>here</p><form><p>Sign up</p></form><aside>side</aside><div class=ad>Buy</div></article>": "Text goes on here",
    "just text": "just text",
    "<p></p>": "",
    "": "",
    "<div><p>unclosed <b>tags <i>all over<p>the place": "unclosed tags all over\n\nthe place",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert page_text.main_text(html) == PAGES[html]


PROSE = ["The first paragraph of the text is long enough to be read as such.", "So is the second paragraph here, which says a little more than that.", "And the third one of them ends what there is to say."]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
FRAMED = "<nav><a href=x>Menu</a></nav>%s<div class='ad'>Buy</div><footer>foot</footer>"


@pytest.mark.parametrize(
    "html",
    [
        *[FRAMED % f"<div class='{name}'><article>{BODY}</article></div>" for name in ("layout no-sidebar", "has-sidebar", "hasSidebar", "with-widget", "nav-fixed")],
        *[FRAMED % f"<div id='{name}'><div>{BODY}</div></div>" for name in ("no-left-sidebar", "nav-fixed", "share")],
        f"<form id=aspnetForm>{FRAMED % f'<main>{BODY}</main>'}</form>",
        f"<form id=aspnetForm>{FRAMED % f'<div>{BODY}</div>'}</form>",
        FRAMED % f"<article><p class='share'>{PROSE[0]}</p><div class='related'><p>{PROSE[1]}</p></div><p id='notice'>{PROSE[2]}</p><div class=share>Tell</div></article>",
        FRAMED % f"<article>{BODY}</article><div class='comments'>{''.join(f'<article class=comment><p>{x}</p></article>' for x in PROSE * 3)}</div>",
    ],
)
def test_main_text_inside_named_wrappers(html):
    assert page_text.main_text(html) == "\n\n".join(PROSE)


def test_extract(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    data = [(k, f"u{k}", h) for k, h in enumerate(PAGES)] + [(90, "n", None), (None, None, "x y"), (91, "d", deep), (91, "d", deep)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = page_text.extract(frame).collect()
    want = [(p, u, page_text.main_text(h) if h else "") for p, u, h in data]
    assert sorted(map(tuple, got), key=str) == sorted(((p, u, t, len(t)) for p, u, t in want), key=str)
    assert page_text.main_text(deep) == "deep text"
    assert page_text.extract(frame.limit(0)).count() == 0


# shards

@pytest.mark.parametrize("limit", [10, 300, 5000, 10**9])
def test_shards(docs, rows, limit, spark):
    many = spark.createDataFrame([(1000 + k, prose(k, 8), None, None, None) for k in range(300)] + rows, DOCS)
    got = sharding.shard(clashing(many, "shard", "depth", "cell"), limit).collect()
    assert len(got) == 300 + len(rows)
    shards = collections.defaultdict(list)
    for r in got:
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["depth"] == len(r["shard"])
        shards[r["shard"]].append(r)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name, members in shards.items():
        size = sum(r["n_bytes"] for r in members)
        assert size == members[0]["shard_bytes"]
        assert size <= limit or len({(r["doc_id"], r["text"]) for r in members}) == 1
        if name:  # the bucket above did not fit
            assert sum(r["n_bytes"] for r in got if r["shard"].startswith(name[:-1])) > limit


def test_shards_of_nothing(empty):
    assert sharding.shard(empty, 100).count() == 0


DEEP = {
    "nested blocks": "<div>" * 100_000 + "x" + "</div>" * 100_000,
    "open inline tags": "<p>" + "<span>" * 100_000 + "x",
    "blocks in a table in a paragraph": "<p><table><tr><td>" + "<div><p>x" * 30_000,
    "open lists": "<ul>" + "<li>x<ul>" * 30_000,
    "tags cut off": "<p>x</p>" + "<a " * 100_000,
    "open comments": "<p>x</p>" + "<!-- " * 100_000,
    "open attributes": "<p>x</p>" + '<a b="' * 50_000,
}


@pytest.mark.parametrize("name", DEEP)
def test_pages_take_time_in_proportion(name):
    start = time.perf_counter()
    assert page_text.main_text(DEEP[name]).startswith("x")
    assert time.perf_counter() - start < 15  # seconds; quadratic work takes minutes


def plain_density(node, body):
    """(density, sum over block children) of a nested (tag, own characters, children), straight from the definition."""

    def below(n, linked=False):
        tag, own, children = n
        linked = linked or tag == "a"
        parts = [below(c, linked) for c in children]
        chars, links = own + sum(p[0] for p in parts), (own if linked else 0) + sum(p[1] for p in parts)
        tags = len(children) + sum(p[2] for p in parts)
        link_tags = sum(1 for c in children if linked or c[0] == "a") + sum(p[3] for p in parts)
        return chars, links, tags, link_tags

    def density(n, linked):
        chars, links, tags, link_tags = below(n, linked)
        if not chars:
            return 0.0
        base = math.log(chars / max(1, chars - links) * links + body * chars + math.e)
        ratio = max(1.0, chars / max(1, links) * max(1, tags) / max(1, link_tags))
        return chars / max(1, tags) * math.log(ratio) / max(1.0, math.log(base))

    out = []

    def walk(n, linked):
        inside = linked or n[0] == "a"
        out.append((density(n, inside), sum(density(c, inside or c[0] == "a") for c in n[2] if c[0] in page_text.BLOCK)))
        for c in n[2]:
            walk(c, inside)

    walk(node, False)
    return out, below(node)


def test_densities_by_definition():
    rng = random.Random(11)

    def grow(depth):
        children = [grow(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return (rng.choice(["div", "p", "a", "b", "section", "span"]), rng.choice([0, 3, 40, 400]), children)

    for _ in range(20):
        root = ("body", 5, [grow(4) for _ in range(3)])
        tags, parents, chars = [], [], []

        def listed(n, above):
            tags.append(n[0])
            parents.append(above)
            chars.append(n[1])
            here = len(tags) - 1
            for c in n[2]:
                listed(c, here)

        listed(root, -1)
        total, links, *_ = plain_density(root, 0.0)[1]
        want, _ = plain_density(root, links / max(1, total))
        got = list(zip(*page_text.densities(tags, parents, chars)))
        assert got == [pytest.approx(w) for w in want]
