"""Similarity join of documents on word n-grams, with vertically partitioned counting.

Documents with equal n-gram sets are one class.  The global order of the n-grams (rare ones
first) is cut into fragments; a class's n-grams fall into one segment a fragment.  The overlap
of two classes is counted fragment by fragment and summed per pair.

Which pairs are counted:

1. *Alive classes.*  A text whose partner shares at least ``t`` of the larger set must share
   some n-grams in any consistent prefix.  Prefixes in hash order, a little longer than needed,
   find the few classes that have enough non-unique n-grams to have a partner at all.
2. *Prefixes.*  In the global order over the alive classes, two linked classes share one of
   their first ``n - ceil(t n) + 1`` n-grams.  Classes with such an n-gram in common, alike
   enough in size and in non-unique n-grams, are candidates.
3. *Groups.*  A large group of near copies would have a pair for every two members.  While many
   candidates are left, each n-gram has a pivot among its members and each member is only counted
   against one of its pivots; members that are in one component by then need no pair.
4. *Blocks.*  What is left, between different components, is counted in full.  N-grams with few open
   pairs give them as rows.  Classes tied by crowded n-grams are a candidate group; its classes are
   dealt to blocks of bounded size, a task gets two blocks, counts their overlaps fragment by fragment
   into one small matrix, gives up pairs that can no longer reach the threshold, and returns a
   spanning forest of the links.  Components are thus those of all links.

N-grams are 64-bit hashes of whole words; so are class ids, hashes of the whole set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import semi_join, small
from quillgraph.llm.links import components
from quillgraph.llm.word_hash import Words, runs
from quillgraph.operators.skew import lookup_join, salted_join
from quillgraph.session import durable

WORDS = 5
FRAGMENTS = 8
#: candidates per prefix n-gram above which pivots are used first
PAIRS_PER_ROW = 4
BINS = 64
#: classes and n-grams of a block of a candidate group, about
BLOCK_CLASSES = 512
BLOCK_TOKENS = 1 << 20
#: n-grams compared at once in a block pair
_COLUMNS = 4096
#: characters of the texts a task holds as n-grams at once
_PIECE = 1 << 22
WORD_HASHES = Words(b" \t\n\x0b\x0c\r")


def shingles(text: str) -> np.ndarray:
    """The text's set of n-gram hashes in rising order; fewer words than one n-gram count as one."""
    words = WORD_HASHES.spans(text.encode())[0]
    return np.unique(runs(words, min(len(words), WORDS))) if len(words) else words


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches cut into pieces of about ``_PIECE`` characters, whatever the session's batch size is."""
    for batch in batches:
        size = batch["text"].map(len).to_numpy(dtype=np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // _PIECE, prepend=0))
        for start, stop in zip(np.r_[0, cut], np.r_[cut, len(batch)]):
            if stop > start:
                yield batch.iloc[start:stop]


def class_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: Column | int):
    """ceil(3 n / 4), the least overlap of a set of size n with a partner."""
    return (3 * n + 3) // 4 if isinstance(n, int) else F.floor((3 * n + 3) / 4).cast("int")


def _slack(n: int) -> int:
    return max(1, n // 10)


def linked(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """100 |a and b| >= 75 |a or b| in whole numbers."""
    return 7 * overlap >= 3 * (n_a + n_b)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, fp) of every row: size of its set and class, null for texts without words."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].to_numpy(),
                    "text_hash": batch["text_hash"].to_numpy(),
                    "n": [len(s) for s in sets],
                    "fp": pd.Series([class_id(s) if len(s) else None for s in sets], dtype="Int64"),
                }
            )

    rows = docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(per_batch, "doc_id string, text_hash long, n int, fp long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def alive_classes(docs: DataFrame) -> DataFrame:
    """(fp) of the classes that share enough n-grams with other classes to have a partner.

    The prefix of a set in hash order has ``n - needed(n) + slack(n)`` n-grams; linked sets share
    at least the smaller slack of the two within both prefixes.  N-grams met in two classes of a
    piece of a batch are settled there and leave it as one row, so a very common one makes a row a piece.
    """

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(_pieces(batches)):
            seen, fps, sizes, prefixes = set(), [], [], []
            for text in batch["text"]:
                tokens = shingles(text)
                n = len(tokens)
                if not n or (fp := class_id(tokens)) in seen:
                    continue
                seen.add(fp)
                fps.append(fp)
                sizes.append(n)
                prefixes.append(tokens[: n - needed(n) + _slack(n)])
            if not fps:
                continue
            owner = np.repeat(np.arange(len(fps)), [len(p) for p in prefixes])
            token, at, times = np.unique(np.concatenate(prefixes).view(np.int64), return_inverse=True, return_counts=True)
            settled = times[at] > 1
            local = np.bincount(owner[settled], minlength=len(fps))
            fps = np.array(fps, dtype=np.int64)
            single, common = ~settled, token[times > 1]
            yield pd.DataFrame({"kind": 0, "key": token[at[single]], "fp": pd.array(fps[owner[single]], dtype="Int64"), "batch": task + number, "hits": 0, "need": 0})
            yield pd.DataFrame({"kind": 0, "key": common, "fp": pd.array([None] * len(common), dtype="Int64"), "batch": task + number, "hits": 0, "need": 0})
            need = [_slack(needed(n)) for n in sizes]
            yield pd.DataFrame({"kind": 1, "key": fps, "fp": pd.array(fps, dtype="Int64"), "batch": task + number, "hits": local, "need": need})

    rows = docs.select(F.col("text")).filter(F.col("text").isNotNull())
    made = rows.mapInPandas(per_batch, "kind int, key long, fp long, batch long, hits int, need int")
    same = W.partitionBy("kind", "key")  # at most a row for each class and batch, hot n-grams one a batch
    others = (F.min("fp").over(same) < F.max("fp").over(same)) | F.max(F.col("fp").isNull()).over(same)
    hit = F.when(F.col("kind") == 1, F.col("hits")).otherwise(others.cast("int"))
    counted = made.withColumn("hit", hit).filter(F.col("fp").isNotNull() & ((F.col("hit") > 0) | (F.col("kind") == 1)))
    per_class = counted.groupBy("fp", "batch").agg(F.sum("hit").alias("hits"), F.max("need").alias("need"))
    return per_class.filter(F.col("hits") >= F.col("need")).select("fp").distinct()


def _token_sets(docs: DataFrame) -> DataFrame:
    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            sets = [s for s in map(shingles, batch["text"]) if len(s)]
            yield pd.DataFrame({"fp": pd.Series([class_id(s) for s in sets], dtype="int64"), "tokens": [s.view(np.int64) for s in sets]})

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(per_batch, "fp long, tokens array<long>")


def ordered_sets(docs: DataFrame, classes: DataFrame, fragments: int) -> DataFrame:
    """(fp, n, s, tokens, cuts, outline) of the alive classes: ``tokens`` are the s n-grams that other alive
    classes have too, in the global order, and ``cuts`` where each fragment ends in them.

    The order is by level, the logarithm of the number of classes in quarter steps, then by
    hash.  The fragments cut it where each has the same share of all occurrences.
    """
    alive = durable(alive_classes(docs).join(classes, "fp").select("fp", "doc_id"))
    texts = semi_join(docs.select("doc_id", "text"), alive.select("doc_id").distinct(), ["doc_id"])
    sets = durable(semi_join(_token_sets(texts), alive.select("fp"), ["fp"]))
    if sets.count() > alive.count():  # an id stands on several rows
        sets = durable(sets.groupBy("fp").agg(F.first("tokens").alias("tokens")))
    each = sets.select("fp", F.explode("tokens").alias("token"))
    level = F.floor(4 * F.log2(F.col("df").cast("double"))).cast("int")
    known = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token", "df", level.alias("level"))
    loads = {r["level"]: r["load"] for r in known.groupBy("level").agg(F.sum("df").alias("load")).collect()}  # at most 256 levels
    total, start, edges = max(1, sum(loads.values())), 0, []
    for k in range(max(loads, default=0) + 1):
        edges.append(start)
        start += loads.get(k, 0)
    first = F.array(*[F.lit(float(e)) for e in edges])
    load = F.array(*[F.lit(float(loads.get(k, 0))) for k in range(len(edges))])
    place = F.get(first, F.col("level")) + (F.col("token") / F.lit(float(1 << 64)) + 0.5) * F.get(load, F.col("level"))
    fragment = F.least(F.lit(fragments - 1), F.floor(place * fragments / total).cast("int"))
    # inside a level the fragment rises with the token, so level and fragment in one number keep the order
    met = each.join(known, "token").select("fp", F.struct((F.col("level") * fragments + fragment).alias("at"), "token").alias("x"))
    found = met.groupBy("fp").agg(F.sort_array(F.collect_list("x")).alias("x")).join(sets.select("fp", F.size("tokens").alias("n")), "fp")
    upto = lambda k: F.size(F.filter("x", lambda x: x["at"] % fragments <= k))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(fragments - 1)), upto)
    found = found.withColumn("s", F.size("x")).filter(F.col("s") >= needed(F.col("n")))
    found = found.select("fp", "n", "s", F.transform("x", lambda x: x["token"]).alias("tokens"), cuts.alias("cuts"))
    return durable(found.withColumn("outline", _outline(F.col("tokens"))))


def _outline(tokens: Column) -> Column:
    """How many n-grams fall into each of ``BINS`` hash bins (32,767 stands for that many or more)."""

    def of_set(values: np.ndarray) -> np.ndarray:
        return np.minimum(np.bincount(np.asarray(values, dtype=np.int64) & (BINS - 1), minlength=BINS), 32767).astype(np.int16)

    @F.pandas_udf("array<smallint>")
    def of_sets(sets: pd.Series) -> pd.Series:
        return sets.map(of_set)

    return of_sets(tokens)


def outlines_allow(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` without those that cannot be linked: two sets share at most, bin by bin, the smaller count.

    A bin that is full counts as the smaller set's size.
    """
    left = sets.select(F.col("fp").alias("a"), F.col("outline").alias("of_a"))
    right = sets.select(F.col("fp").alias("b"), F.col("outline").alias("of_b"))
    least = F.zip_with("of_a", "of_b", lambda x, y: F.least(x, y).cast("int"))
    most = F.aggregate(least, F.lit(0), lambda sum_, x: F.when(x == 32767, F.least("n_a", "n_b")).otherwise(sum_ + x))
    return pairs.join(left, "a").join(right, "b").filter(linked(most, F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a", "n_b")


def _segments(sets: DataFrame) -> DataFrame:
    """(fp, fragment, tokens): the n-grams of each set that fall into each fragment, where there are any."""
    start = lambda k: F.lit(0) if not k else F.get("cuts", F.lit(k - 1))
    of_fragment = lambda k: F.slice("tokens", start(k) + 1, F.get("cuts", F.lit(k)) - start(k))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("fragment"), of_fragment(k).alias("tokens")) for k in range(FRAGMENTS)]))
    return sets.select("fp", parts.alias("p")).select("fp", "p.fragment", "p.tokens").filter(F.size("tokens") > 0)


def count_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, n_a, n_b) that are linked: overlaps by fragment, summed per pair.

    Only the n-grams of classes in a pair are moved: pairs counted small go to the sets, otherwise both sides
    take the classes that they need from one shuffle of the sets.
    """
    pairs = durable(pairs)
    few = small(pairs)
    of = lambda end: pairs.select(F.col(end).alias("fp")).distinct()
    one, two = of("a"), of("b")
    known = sets.select("fp", "tokens", "cuts")
    left = _segments(known if few else known.join(one, "fp", "left_semi")).select(F.col("fp").alias("a"), "fragment", F.col("tokens").alias("of_a"))
    right = _segments(known.join(F.broadcast(two) if few or small(two) else two, "fp", "left_semi"))
    right = right.select(F.col("fp").alias("b"), "fragment", F.col("tokens").alias("of_b"))
    met = (F.broadcast(pairs) if few else pairs).join(left, "a").join(right, ["b", "fragment"])
    partial = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("part"))
    whole = partial.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("part").alias("overlap"))
    return whole.filter(linked(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _may_link(x: str, y: str) -> Column:
    n, m = F.col(f"n_{x}"), F.col(f"n_{y}")
    return linked(F.least(f"s_{x}", f"s_{y}"), n, m)


def join_components(sets: DataFrame) -> DataFrame:
    """(id, root): components of the links between the classes of ``sets``."""
    spark = sets.sparkSession
    take = (F.col("n") - needed(F.col("n")) + 1) - (F.col("n") - F.col("s"))
    prefixes = durable(sets.select("fp", "n", "s", F.slice("tokens", F.lit(1), take).alias("prefix")))
    rows = sets.agg(F.coalesce(F.sum(take), F.lit(0))).first()[0]
    links, roots = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, root long")
    before, tries = None, 0
    while True:
        placed = durable(_open(_with_roots(prefixes, roots)) if tries else _met(prefixes))
        left = placed.select("token", "open").distinct().agg(F.coalesce(F.sum("open"), F.lit(0.0))).first()[0]
        if not left:
            return roots
        # a block pair takes BLOCK_CLASSES open pairs for each row it moves, so pivots stop where blocks are cheap
        last = left <= PAIRS_PER_ROW * rows * (BLOCK_CLASSES if tries else 1) or (tries > 0 and left > 0.7 * before)
        if last:
            found = durable(_rest(placed, sets))
        else:
            found = durable(count_overlaps(outlines_allow(_to_pivot(placed, tries), sets), sets))
        if not found.isEmpty():
            links = durable(links.unionByName(found))
            roots = components(links)
        if last:
            return roots
        before, tries = left, tries + 1


def _postings(prefixes: DataFrame) -> DataFrame:
    return prefixes.select("fp", "n", "s", "root", F.explode("prefix").alias("token"))


def _with_roots(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """The prefix n-grams of every class with its component, which joins the classes before they are taken apart."""
    met = prefixes.join(roots, prefixes["fp"] == roots["id"], "left")
    return _postings(met.select("fp", "n", "s", "prefix", F.coalesce("root", "fp").alias("root")))


def _met(prefixes: DataFrame) -> DataFrame:
    """As ``_open`` while every class is a component of its own: members of n-grams that two classes have."""
    postings = _postings(prefixes.withColumn("root", F.col("fp")))
    members = F.count(F.lit(1)).cast("double")
    per_token = postings.groupBy("token").agg((members * (members - 1) / 2).alias("open"), F.max("fp").alias("most"), members.alias("members"))
    return postings.join(per_token.filter("open > 0"), "token")


def _open(placed: DataFrame) -> DataFrame:
    """Members of n-grams with more than one component, with ``most`` (the largest), ``open`` pairs and ``members``."""
    per_root = placed.groupBy("token", "root").agg(F.count(F.lit(1)).cast("double").alias("c"))
    members, squares = F.sum("c"), F.sum(F.col("c") * F.col("c"))
    per_token = per_root.groupBy("token").agg(((members * members - squares) / 2).alias("open"), F.max_by("root", F.struct("c", "root")).alias("most"), members.alias("members"))
    return placed.join(per_token.filter("open > 0"), "token")


def _to_pivot(placed: DataFrame, tries: int) -> DataFrame:
    """Each member with one pivot: of the pivots of its n-grams, the one it shares most of them with.

    An n-gram's pivot is the member that has most of its own n-grams in common with others; in
    later tries another one.
    """
    member = F.struct("fp", "n", "s", "root")
    rank = F.struct((F.col("s") / F.col("n")).alias("share") if not tries else F.lit(0.0).alias("share"), F.xxhash64("fp", F.lit(tries)).alias("h"))
    pivot = placed.groupBy("token").agg(F.max_by(member, rank).alias("p"))
    met = placed.join(pivot, "token").filter(F.col("root") != F.col("p.root"))
    both = met.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"), F.col("p.fp").alias("b"), F.col("p.n").alias("n_b"), F.col("p.s").alias("s_b"))
    shared = both.filter(_may_link("a", "b")).groupBy("a", "n_a", "b", "n_b").agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("a").agg(F.max_by(F.struct("n_a", "b", "n_b"), F.struct("c", "b")).alias("x"))
    return _distinct(best.select("a", "x.*"))


def _rest(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that tie all components together that have links between them."""
    crowded = F.col("open") > PAIRS_PER_ROW * F.col("members")
    few = count_overlaps(outlines_allow(_few_pairs(placed.filter(~crowded)), sets), sets)
    many = durable(placed.filter(crowded).select("token", "fp", "root"))
    return few if many.isEmpty() else few.unionByName(_block_links(many, sets))


def _few_pairs(placed: DataFrame) -> DataFrame:
    """Candidates between components, some a row: members outside an n-gram's largest component with all others."""
    one = placed.filter(F.col("root") != F.col("most")).select("token", F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"), F.col("root").alias("root_a"))
    two = placed.select("token", F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"), F.col("root").alias("root_b"), "most")
    once = (F.col("root_b") == F.col("most")) | (F.col("a") < F.col("b"))
    return _distinct(one.join(two, "token").filter((F.col("root_a") != F.col("root_b")) & once & _may_link("a", "b")))


def _candidate_groups(placed: DataFrame) -> DataFrame:
    """(fp, root, grp, inside): classes tied by n-grams; ``inside`` are those of the group's largest component."""
    first = placed.groupBy("token").agg(F.min("fp").alias("first"))
    ties = placed.join(first, "token").select(F.col("fp").alias("a"), F.col("first").alias("b")).distinct()
    grouped = components(ties).withColumnRenamed("root", "grp")
    known = placed.select("fp", "root").distinct().join(grouped, placed["fp"] == grouped["id"], "left").select("fp", "root", F.coalesce("grp", "fp").alias("grp"))
    known = durable(known)
    sizes = known.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("grp").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.sum("c").alias("n"))
    met = lookup_join(known, most.drop("n"), ["grp"], by=["fp"], counts=most.select("grp", "n"))
    return met.select("fp", "root", "grp", (F.col("root") == F.col("most")).alias("inside"))


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Classes dealt to the pairs of blocks (grp, cells, i, j) they take part in, with their side.

    A cell holds classes of one group that are alike in size, inside or outside of the group's largest
    component.  Cells of one size or the next one meet, but for two inside cells.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.34)).cast("int")
    rows = rows.withColumn("cell", 2 * band + F.col("inside").cast("int"))
    load = F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("s") / BLOCK_TOKENS)
    cells = durable(rows.groupBy("grp", "cell").agg(F.ceil(load).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")))
    one, two = (cells.select("grp", F.col("cell").alias(x), F.col("blocks").alias(f"blocks_{x}")) for x in "ab")
    meets = (F.col("a") <= F.col("b")) & (F.floor(F.col("b") / 2) - F.floor(F.col("a") / 2) <= 1) & ~((F.col("a") % 2 == 1) & (F.col("b") % 2 == 1))
    met = one.join(two, "grp").filter(meets)  # a group has few cells: one for each size and side
    side = lambda x, y, k: F.struct(F.col(x).alias("cell"), F.struct("a", "b").alias("cells"), F.lit(k).alias("side"), F.col(f"blocks_{x}").alias("own"), F.col(f"blocks_{y}").alias("other"))
    ends = F.when(F.col("a") == F.col("b"), F.array(side("a", "b", 2))).otherwise(F.array(side("a", "b", 0), side("b", "a", 1)))
    ends = met.select("grp", F.explode(ends).alias("e")).select("grp", "e.*")
    dealt = lookup_join(rows, ends, ["grp", "cell"], by=["fp"], counts=cells.select("grp", "cell", "n"))
    here = F.pmod(F.xxhash64("fp"), "own").cast("int")
    dealt = dealt.withColumn("at", here).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    low = F.when(F.col("side") == 0, F.col("at")).when(F.col("side") == 1, F.col("k")).otherwise(F.least("at", "k"))
    high = F.when(F.col("side") == 0, F.col("k")).when(F.col("side") == 1, F.col("at")).otherwise(F.greatest("at", "k"))
    kind = F.when(F.col("side") < 2, F.col("side")).when(F.col("at") == F.col("k"), F.lit(2)).otherwise((F.col("at") > F.col("k")).cast("int"))
    return dealt.select("grp", "cells", low.alias("i"), high.alias("j"), kind.alias("side"), "fp", "root", "n", "tokens", "cuts")


def _block_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links between the components of each candidate group."""
    groups = durable(_candidate_groups(placed))
    rows = sets.select("fp", "n", "s", "tokens", "cuts").join(F.broadcast(groups) if small(groups) else groups, "fp")
    return _block_pairs(rows).groupBy("grp", "cells", "i", "j").applyInPandas(_forest, "a long, b long")


def _forest(block: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of two blocks (sides 0 and 1) or of one (side 2).

    Overlaps are counted by fragment, as products of incidence matrices; after each, pairs that cannot
    reach the threshold with all that is left are given up, and classes without a pair leave.
    """
    side, fp, root = (block[c].to_numpy() for c in ("side", "fp", "root"))
    n, size = block["n"].to_numpy().astype(np.int64), block["tokens"].map(len).to_numpy().astype(np.int64)
    tokens, cuts = block["tokens"].to_numpy(), block["cuts"].to_numpy()
    one = np.flatnonzero(side != 1)
    two = np.flatnonzero(side != 0)
    need = -(-3 * (n[one][:, None] + n[two][None, :]) // 7)
    overlap = np.zeros(need.shape, dtype=np.int64)
    done = np.zeros(len(fp), dtype=np.int64)
    open_ = root[one][:, None] != root[two][None, :]
    for k in range(FRAGMENTS):
        left = size - done
        open_ &= overlap + np.minimum(left[one][:, None], left[two][None, :]) >= need
        if not open_.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        a, b = ([tokens[x][done[x] : cuts[x][k]] for x in ids] for ids in (one[rows], two[cols]))
        overlap[np.ix_(rows, cols)] += _common(a, b)
        done = np.array([c[k] for c in cuts], dtype=np.int64)
    r, c = np.nonzero(open_ & (overlap >= need))
    r, c = one[r], two[c]
    tree, last = np.arange(len(fp)), None
    while last is None or (tree != last).any():
        last = tree.copy()
        np.minimum.at(tree, r, last[c])
        np.minimum.at(tree, c, last[r])
        tree = tree[tree]
    tied = np.flatnonzero(tree != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[tied], "b": fp[tree[tied]]})


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``a`` shares with each of ``b``; values of an array differ."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    flat = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(*flat)
    at, row = [], []
    for values, x in zip(flat, (a, b)):
        place = np.searchsorted(shared, values)
        known = np.flatnonzero(shared[np.minimum(place, len(shared) - 1)] == values) if len(shared) else np.zeros(0, np.int64)
        order = known[np.argsort(place[known], kind="stable")]
        at.append(place[order])
        row.append(np.repeat(np.arange(len(x)), [len(v) for v in x])[order])
    for start in range(0, len(shared), _COLUMNS):  # bounded: a block's rows times _COLUMNS
        marks = []
        for place, r, x in zip(at, row, (a, b)):
            lo, hi = np.searchsorted(place, [start, start + _COLUMNS])
            mark = np.zeros((len(x), min(_COLUMNS, len(shared) - start)), dtype=np.float32)
            mark[r[lo:hi], place[lo:hi] - start] = 1
            marks.append(mark)
        out += (marks[0] @ marks[1].T).astype(np.int64)
    return out


def _distinct(pairs: DataFrame) -> DataFrame:
    low = F.col("a") < F.col("b")
    end = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return pairs.select(end("a", "b").alias("a"), end("b", "a").alias("b"), end("n_a", "n_b").alias("n_a"), end("n_b", "n_a").alias("n_b")).distinct()


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, first_hash.

    Two documents link at a Jaccard similarity of 0.75 or more of their distinct 5-word
    n-grams.  ``component_id`` is the smallest doc_id reachable by links (null ids count as
    larger than any); ``first_hash`` is the text hash of that document.  Null texts and
    texts without words have 0 n-grams and stand alone.  Repeated rows are rows of one class; other
    columns are not read.  An empty table gives an empty table.
    """
    rows = durable(digest(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = durable(rows.filter("n > 0").groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).withColumn("doc_id", F.col("first.doc_id")))
    roots = join_components(ordered_sets(docs, classes.select("fp", "doc_id"), FRAGMENTS))
    inside = classes.join(roots, classes["fp"] == roots["id"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    labels = inside.join(inside.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("first_hash"))
    hot = classes.select("fp", F.col("rows").alias("n"))
    out = salted_join(rows.withColumnRenamed("n", "n_shingles"), labels, ["fp"], "left", by=["doc_id", "text_hash"], counts=hot)
    alone = F.col("fp").isNull()
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("text_hash")).otherwise(F.col("first_hash")).alias("first_hash"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id.  Texts without words all stay.

    Rows that are equal in id and text are copies like any other: one of them stays.
    """
    joined = durable(join(docs))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    name = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")).alias("_id")  # never null
    kept = joined.filter(first).groupBy(name, F.col("text_hash").alias("_hash")).agg(F.max("n_shingles").alias("_size"))
    met = docs.select("*", name, F.xxhash64("text").alias("_hash")).join(kept, ["_id", "_hash"])
    # texts without words are copies of nothing; the rest goes by the keys of the join, without another shuffle
    alone = met.withColumn("_alone", F.when(F.col("_size") == 0, F.monotonically_increasing_id()))
    return alone.dropDuplicates(["_id", "_hash", "_alone"]).select(*docs.columns)
