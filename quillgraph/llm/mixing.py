"""Mixing sources to target weights, in DataFrame expressions only.

A source is cut into blocks by a hash; its blocks stand in a permuted order that is walked
as often as the target needs, so the number of block draws of each source is an exact quota.
A splitting tree deals these quotas to the output shards: at every node the vector of quotas
is split between the two halves by a multivariate hypergeometric draw.  A shard takes the next
draws of each source's walk, so draws are disjoint, and orders its rows by a hash.

All randomness is a hash of the seed and the place, so runs and repeated tasks agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import computed, let, words
from quillgraph.session import durable

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCKS_ROWS = 4096
_OWN = ["size", "source_size", "target", "copies", "draws"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) with ord, weight and target.

    Sources in code-point order, null last, take the weights in turn and share the sum of all
    sizes; no target exceeds ``most`` times its size, and what is cut is shared by weight among
    the rest until none is above.  In closed form: targets are ``min(most * size, level *
    weight)`` with the one level at which they add up.  One row a source, so the windows over
    all rows are as long as the list of sources.
    """
    by_name, rising = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_full", "ord")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("ord"), F.lit(len(weights))))
    listed = sizes.withColumn("ord", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    cap = F.col("source_size").cast("double") * most
    filled = listed.withColumn("_cap", cap).withColumn("_full", F.col("_cap") / F.col("weight"))
    below = F.coalesce(F.sum("_cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(W.partitionBy())
    level = filled.withColumn("_level", (total - below) / above).withColumn("_place", F.row_number().over(rising))
    first = F.min_by(F.when(F.col("_level") <= F.col("_full"), F.col("_level")), F.when(F.col("_level") <= F.col("_full"), F.col("_place")))
    found = level.withColumn("_at", first.over(W.partitionBy()))
    return found.select("source", "source_size", "ord", "weight", F.least("_cap", F.coalesce("_at", F.lit(0.0)) * F.col("weight")).alias("target"))


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series eight steps further up; good to about 1e-11."""
    z = x + F.lit(8.0)
    steps = F.ln((x + 1) * (x + 2) * (x + 3) * (x + 4)) + F.ln((x + 5) * (x + 6) * (x + 7) * (x + 8))
    series = F.lit(1 / 12) / z - F.lit(1 / 360) / (z * z * z) + F.lit(1 / 1260) / (z * z * z * z * z)
    return z * F.ln(z) - z + F.lit(0.5) * F.ln(F.lit(2 * math.pi) * z) + series - steps


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among ``draws`` of ``good + bad`` without putting back, as a bigint.

    Inverse distribution function at ``u`` (0 to 1), by the ratio of neighbouring terms from
    eight deviations below the mean on; what lies beyond has a chance under 1e-14.
    """

    def spread(v: Column) -> Column:
        mean = v["draws"] * v["good"] / F.greatest(v["n"], F.lit(1.0))
        sd = F.sqrt(mean * v["bad"] / F.greatest(v["n"], F.lit(1.0)) * (v["n"] - v["draws"]) / F.greatest(v["n"] - 1, F.lit(1.0)))
        return let(F.struct(mean.alias("mean"), sd.alias("sd")), lambda s: bounds(v, s))

    def bounds(v: Column, s: Column) -> Column:
        low = F.greatest(F.lit(0.0), v["draws"] - v["bad"], F.floor(s["mean"] - s["sd"] * 8 - 2).cast("double"))
        high = F.least(v["good"], v["draws"], F.ceil(s["mean"] + s["sd"] * 8 + 2).cast("double"))
        return let(F.struct(low.alias("low"), F.greatest(low, high).alias("high")), lambda b: walk(v, b))

    def walk(v: Column, b: Column) -> Column:
        plus = F.array(v["good"], v["bad"], v["draws"], v["n"] - v["draws"])
        minus = F.array(v["n"], b["low"], v["good"] - b["low"], v["draws"] - b["low"], v["bad"] - v["draws"] + b["low"])
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + _log_factorial(x))
        start = F.struct(F.exp(total(plus) - total(minus)).alias("p"), F.lit(0.0).alias("below"), b["low"].alias("x"))

        def step(a: Column, j: Column) -> Column:
            through = a["below"] + a["p"]
            following = a["p"] * (v["good"] - j) * (v["draws"] - j) / ((j + 1.0) * (v["bad"] - v["draws"] + j + 1.0))
            return F.struct(following.alias("p"), through.alias("below"), F.when(through < u, j + 1.0).otherwise(a["x"]).alias("x"))

        seen = F.aggregate(F.sequence(b["low"].cast("long"), b["high"].cast("long")), start, step)
        return F.least(seen["x"], b["high"]).cast("long")

    g, b, d = (c.cast("double") for c in (good, bad, draws))
    return let(F.struct(g.alias("good"), b.alias("bad"), d.alias("draws"), (g + b).alias("n")), spread)


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(ord, node, end): for every source and shard the running sum of the source's quota up to this shard.

    ``quotas`` is one row with ``q``, the quotas of the sources in order.  Shards are equal to
    one draw in size.  ``shards`` must be a power of two.
    """
    levels = int(math.log2(shards))
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "q", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    for level in range(levels):
        width = shards >> level  # shards below a node of this level
        edge = lambda k: F.floor(F.col("all") * k / shards).cast("long")
        left_draws = edge(F.col("node") * width + width // 2) - edge(F.col("node") * width)
        chance = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), i), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        here = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(here.alias("rest"), left_draws.alias("draws"), F.array().cast("array<bigint>").alias("left"))

        def deal(a: Column, x: Column) -> Column:
            rest = a["rest"] - x["q"]
            after = lambda g: F.struct(rest.alias("rest"), (a["draws"] - g).alias("draws"), F.concat(a["left"], F.array(g)).alias("left"))
            return let(hypergeometric(x["q"], rest, a["draws"], chance(x["i"])), after)

        numbered = F.transform("q", lambda x, i: F.struct(x.alias("q"), i.alias("i")))
        split = computed(nodes, _left=F.aggregate(numbered, start, deal)["left"])
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("_left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "_left", lambda x, y: x - y).alias("q")),
        )
        nodes = split.select("all", F.explode(halves).alias("h")).select("h.node", "h.q", "all")
    each = nodes.select("node", F.posexplode("q").alias("ord", "q"))
    return each.select("ord", "node", F.sum("q").over(W.partitionBy("ord").orderBy("node")).alias("end"))


def _dealt(walked: DataFrame, ends: DataFrame) -> DataFrame:
    """(_name, _block, _draws): the draws of each block with their shards.

    A draw goes to the shard whose run of the source's walk it lies in: as many shards end at or before it.
    Draws of blocks and ends of shards are narrow rows, few against the documents.
    """
    draws = walked.select("ord", F.explode("_walked").alias("at"), F.lit(1).alias("kind"), "_name", "_block")
    edges = ends.select("ord", F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("_name"), F.lit(None).cast("long").alias("_block"))
    upto = W.partitionBy("ord").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    placed = edges.unionByName(draws).withColumn("shard", F.count_if(F.col("kind") == 0).over(upto).cast("int")).filter("kind = 1")
    each = F.collect_list(F.struct(F.col("at").alias("draw"), "shard"))
    return placed.groupBy("_name", "_block").agg(F.transform(F.sort_array(each), lambda d: F.struct(d["shard"].alias("shard"), d["draw"].alias("draw"))).alias("_draws"))


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, shard_words: int = 1 << 22, seed: int = 11) -> DataFrame:
    """``docs`` with size, source_size, target, copies and draws; columns of these names are replaced.

    ``draws`` has one (shard, draw) for each copy of the row in the mix; ``copies`` is their
    number, at most ``most``.  A null source is a source of its own; null and empty texts have
    size 0.  Equal rows fall into the same block and are drawn as separate rows.  The last,
    partly used block of a source is cut where its target is nearest.  An empty table gives an
    empty table.  Shards are the power of two that holds about
    ``shard_words`` words each, so their number follows the corpus.
    """
    keep = [c for c in docs.columns if c not in _OWN]
    size = F.size(words(F.col("text"))).cast("long")
    buckets = max(16, docs.count() // BLOCKS_ROWS)
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    key = F.xxhash64("doc_id", "text")
    rows = computed(docs, _size=size, _key=key, _name=name, _block=F.pmod(key, F.lit(buckets)))
    blocks = durable(rows.groupBy("_name", "_block").agg(F.sum("_size").alias("_words")))
    total = blocks.agg(F.coalesce(F.sum("_words"), F.lit(0))).first()[0]
    shards = 1 << max(0, math.ceil(math.log2(max(1, total / shard_words))))
    named = blocks.groupBy("_name").agg(F.sum("_words").alias("source_size"), F.count(F.lit(1)).alias("_blocks"))
    source = F.when(F.col("_name") != "n", F.substring("_name", 2, 1 << 30))
    wanted = targets(named.withColumn("source", source).drop("_blocks", "_name"), weights, most)
    wanted = wanted.withColumn("_name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).join(named.select("_name", "_blocks"), "_name")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = durable(wanted.withColumn("_full", full).withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size")).drop("source"))
    walk = W.partitionBy("_name").orderBy(F.xxhash64(F.lit(seed), "_name", "_block"), "_block")
    before = F.coalesce(F.sum("_words").over(walk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = durable(blocks.withColumn("_before", before).withColumn("_at", F.row_number().over(walk) - 1).join(wanted, "_name"))
    begun = F.col("_before") < F.col("_rest")
    quota = placed.groupBy("ord").agg((F.max(F.col("_full") * F.col("_blocks")) + F.count_if(begun)).alias("q"))
    one_row = quota.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "q"))), lambda x: x["q"]).alias("q"))
    ends = shard_quotas(one_row, shards, seed)
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_full")), lambda e: (e - 1) * F.col("_blocks") + F.col("_at"))
    walked = F.concat(F.when(F.col("_full") > 0, whole).otherwise(F.array().cast("array<bigint>")), F.when(begun, F.array(F.col("_full") * F.col("_blocks") + F.col("_at"))).otherwise(F.array().cast("array<bigint>")))
    drawn = placed.join(_dealt(placed.withColumn("_walked", walked), ends), ["_name", "_block"], "left")
    drawn = drawn.select("_name", "_block", "source_size", "target", "_full", "_rest", "_before", "_draws")
    within = W.partitionBy("_name", "_block").orderBy("_key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    met = rows.join(drawn, ["_name", "_block"]).withColumn("_upto", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    partly = begun & (F.col("_before") + F.col("_upto") + F.col("_size") / 2 <= F.col("_rest"))
    copies = (F.col("_full") + partly.cast("long")).cast("int")
    draws = F.when(copies > 0, F.slice("_draws", F.lit(1), copies)).otherwise(F.array().cast("array<struct<shard:int,draw:bigint>>"))
    return met.select(*keep, F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), draws.alias("draws"))


def copies(planned: DataFrame, *keep: str, seed: int = 11, by: str = "doc_id") -> DataFrame:
    """The mix drawn from a ``plan``: a row with the ``keep`` columns for every copy with its ``shard`` and ``draw``, in hash order inside a shard."""
    rows = planned.select(*keep, by, F.explode("draws").alias("_d")).select(*keep, F.col(by).alias("_by"), "_d.shard", "_d.draw")
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "draw", "_by"), "_by").drop("_by")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for every copy with its ``shard`` and ``draw``, in hash order inside a shard.

    Columns of these names are replaced; all others of ``docs`` are kept as they are.
    """
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")
    drawn = copies(plan(boxed, **options), "_row", seed=options.get("seed", 11))
    return drawn.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "draw")], "shard", "draw")


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, shards.

    The mix is drawn, and ``taken`` sums the words of the row's copies in it; ``shards`` are the shards they
    went to, in order.  Rows that were not drawn take 0.  Texts are not carried along.
    """
    planned = plan(docs.select("doc_id", "text", "source"), **options).select("doc_id", "size", "source_size", "target", "draws")
    planned = durable(planned.withColumn("_row", F.monotonically_increasing_id()))
    drawn = copies(planned, "_row", "size", seed=options.get("seed", 11)).groupBy("_row")
    found = drawn.agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    met = planned.join(found, "_row", "left")
    return met.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
