"""Graph operators on DataFrames: edges (src, dst, ...) and vertices (id, ...).

Iterative operators run as rounds of one join and one aggregation.  State is made
durable between rounds, so a lost executor re-reads the last round.  Vertices with a
large share of the edges are split (see ``skew``); messages are combined before they are
shuffled, so a vertex many others point at costs no more than the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.ids import dense_ids
from quillgraph.operators.skew import PART, HotKeys, count_keys, lookup_join, salted_join
from quillgraph.session import durable

CHANGED = "changed"
#: edges that one task may walk, some MB
SMALL_LINKS = 1 << 16
#: trimming goes on while it leaves less than this share of the edges
TRIM_WORTH = 0.95


def vertices_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All vertex ids: edge ends and, if given, the ids of ``nodes``."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id"))
    return ends.distinct()


def graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges); a vertex named only by an edge has null attributes."""
    return vertices_of(edges, nodes).join(nodes, "id", "left"), edges


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every vertex with an edge, one pass over the edges."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), zero.alias("i"), one.alias("o")),
                F.struct(F.col("dst").alias("id"), one.alias("i"), zero.alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return sums.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def max_degrees(degree_rows: DataFrame) -> DataFrame:
    """The vertex with the largest degree of each kind; ties go to the lowest id."""
    kinds = ["in_degree", "out_degree", "degree"]
    best = degree_rows.agg(
        *[F.max_by(F.struct("id", F.col(k).alias("value")), F.struct(F.col(k), -F.col("id"))).alias(k) for k in kinds]
    )
    return best.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k)["id"].alias("id"), F.col(k)["value"].alias("value")) for k in kinds])).alias("r")
    ).select("r.*")


class SplitEdges:
    """An edge table made ready for rounds: hot senders split, laid out by sender once.

    Rounds then move vertex states and combined messages, never the edges.  The layout is
    cached over a durable table, so a lost executor rebuilds its share from files.
    """

    def __init__(self, edges: DataFrame, hot: HotKeys | None = None, **bounds: int) -> None:
        keyed = durable(edges.withColumnRenamed("src", "id"))
        self.hot = hot or HotKeys(count_keys(keyed, ["id"]), ["id"], **bounds)
        by = ["id", PART] if self.hot.any else ["id"]
        partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid_out = self.hot.spread(keyed, by=["dst"]).repartition(partitions, *by).sortWithinPartitions(*by)
        self.edges = laid_out.persist(StorageLevel.MEMORY_AND_DISK)

    def meet(self, state: DataFrame) -> DataFrame:
        """Every edge with the state of its source; the source id is ``id``."""
        return self.hot.join_spread(self.edges, state)

    def release(self) -> None:
        self.edges.unpersist()


def pregel(
    vertices: DataFrame,
    edges: DataFrame,
    *,
    hot: HotKeys | None = None,
    send: Mapping[str, Column],
    merge: Mapping[str, Column] | Callable[[DataFrame], DataFrame],
    update: Mapping[str, Column],
    changed: Column,
    send_when: Column | None = None,
    all_send: bool = False,
    max_rounds: int | None = None,
    rounds_per_stage: int = 1,
) -> tuple[DataFrame, int]:
    """Rounds of message passing along edges until no vertex changes.

    ``vertices`` has id and the state columns.  A round: every vertex that changed (all of
    them with ``all_send``) sends, per outgoing edge, the ``send`` columns built from its
    state and the edge; ``merge`` aggregates them per receiver ``id`` (columns, or a function of the
    messages where one aggregation is not enough); ``update`` gives the new
    state columns from the old state and the merged message (null without one);
    ``changed`` compares ``old_<column>`` with ``<column>``.  Vertices all send in round 1,
    or those where ``send_when`` holds.

    State is made durable and tested for changes every ``rounds_per_stage`` rounds.  Where all
    send, further rounds go on changing the state, so a stage keeps the state after each of its
    rounds and the first one without a change is the result, whatever ``rounds_per_stage`` is.
    ``hot`` are the hot senders if already known.  Returns the final state and the number
    of rounds run.
    """
    state_columns = list(update)
    split = SplitEdges(edges, hot)
    first = F.lit(True) if send_when is None else send_when
    state = vertices.select("id", *state_columns, first.alias(CHANGED))
    done = 0
    while max_rounds is None or done < max_rounds:
        steps = rounds_per_stage if max_rounds is None else min(rounds_per_stage, max_rounds - done)
        trail = []
        for step in range(steps):
            sending = state if all_send else state.filter(CHANGED)
            messages = (
                split.meet(sending.drop(CHANGED, *trail))
                .select(F.col("dst").alias("id"), *[c.alias(n) for n, c in send.items()])
            )
            messages = merge(messages) if callable(merge) else messages.groupBy("id").agg(*[c.alias(n) for n, c in merge.items()])
            met = state.drop(CHANGED).join(messages, "id", "left")
            old = [F.col(c).alias(f"old_{c}") for c in state_columns]
            fresh = met.select("id", *trail, *old, *[update[c].alias(c) for c in state_columns])
            state = fresh.select("id", *trail, *state_columns, F.coalesce(changed, F.lit(False)).alias(CHANGED))
            if all_send:
                trail.append(f"_after{step}")
                state = state.withColumn(trail[-1], F.struct(*state_columns, CHANGED))
        state = durable(state)
        moved = state.agg(*[F.max(F.col(t)[CHANGED]) for t in trail or []], F.max(CHANGED)).first()
        still = next((k for k, m in enumerate(moved) if not m), None)
        done += steps if still is None or not trail else still + 1
        if still is not None:
            state = state.select("id", f"{trail[still]}.*") if trail else state
            break
        state = state.drop(*trail)
    split.release()
    return state.drop(CHANGED), done


def pagerank(
    vertices: DataFrame,
    edges: DataFrame,
    *,
    tol: float = 1e-4,
    rounds: int | None = None,
    rounds_per_stage: int = 4,
    normalize: bool = False,
) -> DataFrame:
    """(id, rank) with rank = 0.15 + 0.85 * sum(rank_src / out_degree_src).

    Ranks start at 1, close to the fixed point.  Runs ``rounds`` rounds if given, else until no
    rank moves by more than ``tol``, however many rounds that takes (``rounds_per_stage`` of them
    between two writes, without effect on the ranks).  Parallel edges count each.  ``normalize`` scales the ranks to sum to the number of vertices.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    # out-degree is one more column of the sender's state, not a join with the edges
    start = vertices.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").select(
        "id", F.coalesce("out", F.lit(1)).alias("out"), F.lit(1.0).alias("rank")
    )
    state, _ = pregel(
        start,
        pairs,
        send={"part": F.col("rank") * F.col("n") / F.col("out")},
        merge={"total": F.sum("part")},
        update={"rank": F.lit(0.15) + F.lit(0.85) * F.coalesce("total", F.lit(0.0)), "out": F.col("out")},
        changed=F.lit(True) if rounds is not None else F.abs(F.col("rank") - F.col("old_rank")) > tol,
        all_send=True,
        max_rounds=rounds,
        rounds_per_stage=rounds_per_stage,
    )
    ranks = state.select("id", "rank")
    if normalize:
        scale = ranks.agg(F.count(F.lit(1)) / F.sum("rank")).scalar()
        ranks = ranks.withColumn("rank", F.col("rank") * scale)
    return ranks


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: int, *, rounds_per_stage: int = 2) -> DataFrame:
    """(id, dist, path) from ``source`` along weighted edges (src, dst, weight).

    Unreached vertices have infinite distance and an empty path.  Of equally long ways the
    one with fewer edges wins, then the one that is smaller read from its end, so results do not depend on
    timing.  Weights must not be negative.

    A message is a distance and a number of edges, whatever the depth.  Predecessors are picked once, when
    all distances stand, and the paths are written out by pointer doubling.
    """
    far, at_source = F.lit(float("inf")), F.col("id") == F.lit(source)
    ways = durable(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    start = vertices.select(
        "id", F.when(at_source, F.lit(0.0)).otherwise(far).alias("dist"), F.when(at_source, F.lit(0)).alias("hops")
    )

    def least(offers: DataFrame) -> DataFrame:
        # distances of a receiver differ after the first step, so the second has no ties; both hash
        each = offers.groupBy("id", "way").agg(F.min("steps").alias("steps"))
        return each.groupBy("id").agg(F.min_by("steps", "way").alias("steps"), F.min("way").alias("way"))

    better = F.col("way").isNotNull() & ((F.col("way") < F.col("dist")) | ((F.col("way") == F.col("dist")) & (F.col("steps") < F.col("hops"))))
    state, _ = pregel(
        start,
        ways,
        send={"way": F.col("dist") + F.col("weight"), "steps": F.col("hops") + 1},
        merge=least,
        update={
            "dist": F.when(better, F.col("way")).otherwise(F.col("dist")),
            "hops": F.when(better, F.col("steps")).otherwise(F.col("hops")),
        },
        changed=(F.col("dist") < F.col("old_dist")) | (F.col("hops") < F.col("old_hops")),
        send_when=at_source,
        rounds_per_stage=rounds_per_stage,
    )
    reached = state.filter("hops IS NOT NULL")
    paths = _written_out(_predecessors(reached, ways)).withColumnRenamed("path", "_path")
    met = state.select("id", "dist").join(paths, "id", "left")
    here = F.when(at_source, F.array(F.col("id").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return met.select("id", "dist", F.coalesce("_path", here).alias("path"))


def _predecessors(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, up): of the edges that end a best way, the smallest source; the start has none."""
    ends = [reached.select(F.col("id").alias(e), F.col("dist").alias(f"{e}_dist"), F.col("hops").alias(f"{e}_hops")) for e in ("src", "dst")]
    met = lookup_join(edges, ends[0], ["src"], by=["dst"])
    met = lookup_join(met, ends[1], ["dst"], by=["src"])
    best = (F.col("src_dist") + F.col("weight") == F.col("dst_dist")) & (F.col("src_hops") + 1 == F.col("dst_hops"))
    return met.filter(best).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"))


def _written_out(tree: DataFrame) -> DataFrame:
    """(id, path): the way from the root to every vertex of a tree (id, up); each round doubles what is known."""
    known = durable(tree.select("id", "up", F.array(F.col("id").cast("long")).alias("path")))
    while True:
        above = known.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        longer = lookup_join(known, above, ["up"], "left", by=["id"])
        known = durable(longer.select("id", F.coalesce("_up", "up").alias("up"), F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path"), F.col("_up").isNotNull().alias("on")))
        if known.filter("on").isEmpty():
            return known.select("id", F.concat(F.array(F.col("up").cast("long")), "path").alias("path"))
        known = known.drop("on")


def strongly_connected_components(
    vertices: DataFrame, edges: DataFrame, *, max_rounds: int | None = None, rounds_per_stage: int = 3, small_links: int = SMALL_LINKS
) -> DataFrame:
    """(id, component): the lowest vertex id of each strongly connected component.

    An outer round: (1) vertices without a way in or out leave as components of their own, again and again as long
    as that takes away a share of the edges; (2) the smallest labels spread until stable, along the edges and
    against them at once; (3) a vertex that got one label from both sides lies on a cycle with the label's
    vertex: it belongs to that component and leaves.  Of the rest only edges between
    vertices with the same two labels stay, no component crosses the others.  Vertices are
    numbered anew in the order of a hash: with the ids themselves a long chain in id order would lose one
    vertex per round, hashes cut it into pieces, and labels are plain numbers.

    Labels need as many rounds as the longest way has edges.  Once (1) has left ``small_links`` edges at most, a
    number that does not grow with the graph, the rest is a depth-first walk in one task instead.

    ``max_rounds`` bounds the outer rounds; what is then left keeps its own id.
    """
    links = durable(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct())
    names = _hash_order(vertices_of(links, vertices))
    links = durable(_renumbered(links, names))
    # edges only ever leave, so keys hot now cover all that are hot later, at either end
    ends = links.select(F.explode(F.array("src", "dst")).alias("id"))
    hot = HotKeys(count_keys(ends, ["id"]), ["id"])

    def both_ends(facts: DataFrame, *columns: str) -> DataFrame:
        """Edges whose two ends are in ``facts``, with its columns as src_* and dst_*."""
        at = [facts.select("id", *[F.col(c).alias(f"{end}_{c}") for c in columns]) for end in ("src", "dst")]
        one = hot.join(links.withColumnRenamed("src", "id"), at[0], by=["dst"]).withColumnRenamed("id", "src")
        return hot.join(one.withColumnRenamed("dst", "id"), at[1], by=["src"]).withColumnRenamed("id", "dst")

    found: list[DataFrame] = []
    done, size = 0, links.count()
    while max_rounds is None or done < max_rounds:
        done += 1
        # 1. trim
        before = None
        while size and (before is None or size > small_links and size < TRIM_WORTH * before):
            ways = degrees(links).filter((F.col("in_degree") > 0) & (F.col("out_degree") > 0)).select("id")
            links = durable(both_ends(ways).select("src", "dst"))
            before, size = size, links.count()
        if not size:
            break
        if max_rounds is None and size <= small_links:
            found.append(durable(links.repartition(1).mapInPandas(_walked, "id long, root long")))
            break
        # 2. labels from both sides
        there = links.select("src", "dst", F.lit(True).alias("forth"))
        back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("forth"))
        labels, _ = pregel(
            vertices_of(links).select("id", F.col("id").alias("above"), F.col("id").alias("below")),
            there.unionByName(back),
            hot=hot,
            send={"a": F.when(F.col("forth"), F.col("above")), "b": F.when(~F.col("forth"), F.col("below"))},
            merge={"least_a": F.min("a"), "least_b": F.min("b")},
            update={"above": F.least("above", "least_a"), "below": F.least("below", "least_b")},
            changed=(F.col("above") < F.col("old_above")) | (F.col("below") < F.col("old_below")),
            rounds_per_stage=rounds_per_stage,
        )
        # 3. take out what agrees
        agree = F.col("above") == F.col("below")
        found.append(labels.filter(agree).select("id", F.col("above").alias("root")))
        same = (F.col("src_above") == F.col("dst_above")) & (F.col("src_below") == F.col("dst_below"))
        links = durable(both_ends(labels.filter(~agree), "above", "below").filter(same).select("src", "dst"))
        size = links.count()
    members = names
    if found:
        roots = found[0]
        for more in found[1:]:
            roots = roots.unionByName(more)
        members = names.join(roots.withColumnRenamed("id", "v"), "v", "left")
    # who is in none of them has no way in or out, or is left over
    members = durable(members.select("id", (F.coalesce("root", "v") if found else F.col("v")).alias("root")))
    lowest = members.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n"))
    return salted_join(members, lowest.drop("n"), ["root"], by=["id"], counts=lowest.select("root", "n")).select("id", "component")


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, root) of the ends of a few links (src, dst): Tarjan's walk, with a list for the way back."""
    rows = pd.concat([pd.DataFrame({"src": [], "dst": []}, dtype="int64"), *batches])
    ids, ends = np.unique(rows[["src", "dst"]].to_numpy(), return_inverse=True)
    src, dst = ends.reshape(-1, 2).T
    order = np.argsort(src, kind="stable")
    nexts, stops = dst[order].tolist(), np.searchsorted(src[order], np.arange(len(ids) + 1)).tolist()
    at, seen, low, root, kept, count = stops[:-1], [-1] * len(ids), [0] * len(ids), [-1] * len(ids), [], 0
    for start in range(len(ids)):
        way = [start] if seen[start] < 0 else []
        while way:
            v = way[-1]
            if seen[v] < 0:
                seen[v] = low[v] = count
                count += 1
                kept.append(v)
            if at[v] < stops[v + 1]:
                w = nexts[at[v]]
                at[v] += 1
                if seen[w] < 0:
                    way.append(w)
                elif root[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            way.pop()
            if low[v] == seen[v]:
                while root[v] < 0:
                    root[kept.pop()] = v
            elif way:
                low[way[-1]] = min(low[way[-1]], low[v])
    yield pd.DataFrame({"id": ids, "root": ids[np.array(root, dtype=np.int64)]})


def _hash_order(ids: DataFrame) -> DataFrame:
    """(id, v): vertices numbered in the order of a hash of their ids."""
    key = F.struct(F.xxhash64("id").alias("h"), "id").alias("key")
    return durable(dense_ids(ids.select(key), "key", "v").select(F.col("key.id").alias("id"), "v"))


def _renumbered(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (src, dst) with the numbers of their ends."""
    for end, other in (("src", "dst"), ("dst", "src")):
        links = lookup_join(links, names.select(F.col("id").alias(end), F.col("v").alias("_v")), [end], by=[other]).drop(end).withColumnRenamed("_v", end)
    return links.select("src", "dst")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("num")).orderBy(F.desc("num"), "component")


def named(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names for vertex rows; vertices without a name drop out."""
    return rows.join(nodes, "id")
