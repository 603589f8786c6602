"""Graph operators against plain Python, with and without split vertices."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as gr
from quillgraph.operators import skew

N = 34


@pytest.fixture(scope="module")
def links():
    """Cycle, chain, self loop, parallel edges, a hub with a third of all edges, isolated vertices."""
    rnd = random.Random(3)
    out = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(26)]
    out += [(20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (24, 25), (25, 25), (26, 27), (26, 27)]
    return out + [(5, v) for v in range(6, 24)]


@pytest.fixture(scope="module", params=["plain", "split"])
def graph(request, spark, links):
    mp = pytest.MonkeyPatch()
    if request.param == "split":
        init = skew.HotKeys.__init__
        mp.setattr(skew.HotKeys, "__init__", lambda self, c, k, **_: init(self, c, k, max_share=20, min_rows=2))
    edges = spark.createDataFrame([(a, b, float(1 + (a * 7 + b) % 4)) for a, b in links], "src long, dst long, weight double")
    yield spark.range(N), edges
    mp.undo()


def test_degrees(graph, links):
    _, edges = graph
    deg = gr.degrees(edges)
    out, into = Counter(a for a, _ in links), Counter(b for _, b in links)
    got = {r.id: (r.in_degree, r.out_degree, r.degree) for r in deg.collect()}
    assert got == {v: (into[v], out[v], into[v] + out[v]) for v in set(out) | set(into)}
    best = {r.kind: (r.id, r.value) for r in gr.max_degrees(deg).collect()}
    want = lambda c: min((-n, v) for v, n in c.items())
    for kind, counter in (("in_degree", into), ("out_degree", out), ("degree", into + out)):
        n, v = want(counter)
        assert best[kind] == (v, -n)


def test_graph_adds_unnamed_vertices(spark, graph):
    _, edges = graph
    vertices, _ = gr.graph(spark.createDataFrame([(0, "zero"), (99, "alone")], "id long, name string"), edges)
    names = {r.id: r.name for r in vertices.collect()}
    assert names[0] == "zero" and names[99] == "alone" and names[5] is None


def test_pagerank(graph, links):
    vertices, edges = graph
    out = Counter(a for a, _ in links)
    rank = {v: 1.0 for v in range(N)}
    for _ in range(7):
        fresh = {v: 0.15 for v in rank}
        for a, b in links:
            fresh[b] += 0.85 * rank[a] / out[a]
        rank = fresh
    got = {r.id: r.rank for r in gr.pagerank(vertices, edges, rounds=7).collect()}
    assert got == pytest.approx(rank, abs=1e-12)


def test_pagerank_reaches_the_fixed_point(graph, links):
    vertices, edges = graph
    got = {r.id: r.rank for r in gr.pagerank(vertices, edges, tol=1e-4, normalize=False).collect()}
    out = Counter(a for a, _ in links)
    fresh = {v: 0.15 for v in got}
    for a, b in links:
        fresh[b] += 0.85 * got[a] / out[a]
    assert max(abs(fresh[v] - got[v]) for v in got) <= 1e-4
    scaled = gr.pagerank(vertices, edges, rounds=4, normalize=True).agg(F.sum("rank").alias("s")).first().s
    assert scaled == pytest.approx(N)


def test_shortest_paths(graph, links):
    vertices, edges = graph
    best = {v: (float("inf"), -1, ()) for v in range(N)}
    best[5] = (0.0, 0, (5,))
    for _ in range(N):
        for a, b in links:
            d, hops, path = best[a]
            if d < float("inf"):
                best[b] = min(best[b], (d + 1 + (a * 7 + b) % 4, hops + 1, (b, *path)))  # read from the end
    got = {r.id: (r.dist, tuple(r.path)) for r in gr.shortest_paths(vertices, edges, 5).collect()}
    assert got == {v: (d, p[::-1]) for v, (d, _, p) in best.items()}


def test_strongly_connected_components(graph, links):
    vertices, edges = graph
    reach = {v: {v} for v in range(N)}
    moving = True
    while moving:
        moving = False
        for a, b in links:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                moving = True
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in range(N)}
    found = gr.strongly_connected_components(vertices, edges)
    assert {r.id: r.component for r in found.collect()} == want
    sizes = {r.component: r.num for r in gr.component_sizes(found).collect()}
    assert sizes == Counter(want.values())
    names = vertices.select("id", F.concat(F.lit("v"), "id").alias("name"))
    assert gr.named(found, names).count() == N


def _sizes(vertices, edges, **options):
    return {r.id: r.component for r in gr.strongly_connected_components(vertices, edges, **options).collect()}


def test_components_by_labels_and_by_a_walk(spark, graph):
    vertices, edges = graph
    assert _sizes(vertices, edges, small_links=0) == _sizes(vertices, edges)


def test_components_at_the_end_of_long_ways_need_no_round_an_edge(spark, monkeypatch):
    """A cycle of 300 with a tail of 50: its labels would take some 300 rounds."""
    monkeypatch.setattr(gr, "pregel", lambda *a, **k: pytest.fail("labels"))
    ways = [(v, (v + 1) % 300) for v in range(300)] + [(v, v + 1) for v in range(299, 350)] + [(None, 4), (7, 7)]
    edges = spark.createDataFrame(ways, "src long, dst long")
    found = _sizes(spark.createDataFrame([(400,), (3,)], "id long"), edges)
    assert found == {v: 0 if v < 300 else v for v in [*range(351), 400]}
    assert _sizes(spark.range(3), edges.limit(0)) == {0: 0, 1: 1, 2: 2}


def test_trimming_goes_on_while_it_pays(spark, monkeypatch):
    """A tree of ways into one cycle is gone before any label is sent."""
    sent, pregel = [], gr.pregel
    monkeypatch.setattr(gr, "pregel", lambda v, e, **k: (sent.append(e.count()), pregel(v, e, **k))[1])
    ways = [(v, (v - 1) // 2) for v in range(1, 127)] + [(0, 200), (200, 0)]
    found = _sizes(spark.range(1), spark.createDataFrame(ways, "src long, dst long"), small_links=0)
    assert found == {v: 0 if v == 200 else v for v in [*range(127), 200]} and sent == [4]


def test_pregel_with_a_round_limit(graph):
    vertices, edges = graph
    start = vertices.select("id", F.when(F.col("id") == 20, 0).alias("hops"))
    state, rounds = gr.pregel(
        start,
        edges,
        send={"h": F.col("hops") + 1},
        merge={"best": F.min("h")},
        update={"hops": F.least("hops", "best")},
        changed=~F.col("hops").eqNullSafe(F.col("old_hops")),
        send_when=F.col("hops").isNotNull(),
        max_rounds=2,
    )
    reached = {r.id: r.hops for r in state.filter("hops is not null").collect()}
    assert rounds == 2 and reached == {20: 0, 21: 1, 22: 2}
