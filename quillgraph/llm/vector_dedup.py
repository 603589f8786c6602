"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

Equal vectors are one class.  Centroids are fitted on a bounded sample; every class lives in
the cell of its nearest centroid and also visits the cells whose centroid is nearly as near.  Of two
linked vectors at home in different cells, at most half their distance can lie on each side of the plane
between the centroids, so at least one of them is near enough to visit the other; they are compared
in the cell of lower number if they can meet there, else in the other.  A cell is cut into blocks of
bounded size and every pair of blocks is one task, which returns link counts and one spanning forest
of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import computed, in_sample
from quillgraph.llm.links import components
from quillgraph.operators.skew import lookup_join
from quillgraph.session import durable

CELL_ROWS = 2000
MAX_CELLS = 1024
BLOCK_ROWS = 2048
PARTITIONS = 8
#: rows compared with all centroids at once
BATCH_ROWS = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is there, has only finite components and is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors, width: int) -> np.ndarray:
    """Rows of length 1 in double precision, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x = np.asarray(v, dtype=np.float64)
        x = x / np.abs(x).max()  # no overflow or underflow in the squares
        out[k, : len(x)] = x / np.sqrt(x @ x)
    return out


def centroids(classes: DataFrame, width: int, cells: int, *, max_sample: int = 20_000, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on about ``max_sample`` classes (a hash sample), started at sampled vectors."""
    sample = durable(classes.filter(in_sample(classes, max_sample, "h1", "h2")).select("h1", "h2", "vector").repartition(PARTITIONS, "h1"))
    start = sample.orderBy(F.xxhash64("h1", "h2", F.lit(5)), "h1").limit(cells).select("vector").collect()
    centers = _unit([r["vector"] for r in start], width)
    for _ in range(rounds):

        def part(batches: Iterator[pd.DataFrame], centers=centers) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(centers)
            for batch in batches:
                x = _unit(batch["vector"].tolist(), width)
                np.add.at(total, (x @ centers.T).argmax(axis=1), x)
            yield pd.DataFrame({"total": [total.tobytes()]})

        rows = sample.select("vector").mapInPandas(part, "total binary").collect()  # PARTITIONS tables of the centroids' size
        total = np.sum([np.frombuffer(r["total"]).reshape(centers.shape) for r in rows], axis=0)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centers = np.where(norm > 0, total / np.maximum(norm, 1e-300), centers)
    return centers


def _visits(near: np.ndarray, centers: np.ndarray, least: float, margin: float | None) -> np.ndarray:
    """(row, cell): the home of every row and the cells it visits, from its cosines to all centroids."""
    home = near.argmax(axis=1)
    behind = near.max(axis=1, keepdims=True) - near
    if margin is None:
        apart = np.sqrt(np.maximum(0.0, (centers * centers).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * centers @ centers.T))
        reach = np.sqrt(2 * (1 - least)) / 2 * apart[home] + 1e-9
    else:
        reach = margin
    visits = behind <= reach
    visits[np.arange(len(home)), home] = True
    return visits


def _placed(classes: DataFrame, centers: np.ndarray, width: int, least: float, margin: float | None) -> DataFrame:
    """(cell, home, cid, m, vector, lower): each class in its own cell (home) and in those it visits.

    At home it carries the cells of lower number that it visits.
    """

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), BATCH_ROWS):
                batch = whole.iloc[at : at + BATCH_ROWS]
                near = _unit(batch["vector"].tolist(), width) @ centers.T
                home, visits = near.argmax(axis=1), _visits(near, centers, least, margin)
                row, cell = np.nonzero(visits)
                lower = [np.flatnonzero(v[:h]) for v, h in zip(visits, home)]
                none = np.zeros(0, dtype=np.int64)
                yield pd.DataFrame(
                    {
                        "cell": cell.astype(np.int32),
                        "home": home[row].astype(np.int32),
                        "cid": batch["cid"].to_numpy()[row],
                        "m": batch["m"].to_numpy()[row],
                        "vector": batch["vector"].to_numpy()[row],
                        "lower": [lower[r] if c == home[r] else none for r, c in zip(row, cell)],
                    }
                )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("cid", "m", "vector").mapInPandas(per_batch, f"cell int, home int, cid long, m long, vector {kind}, lower array<int>")


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Rows dealt to the pairs of blocks (cell, i, j, visit) they take part in, with their side.

    Residents meet residents (i <= j) and visitors; visitors of a cell do not meet there.
    """
    at_home = F.col("home") == F.col("cell")
    counted = placed.groupBy("cell", at_home.alias("own")).agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).cast("int").alias("blocks"))  # two rows a cell
    sizes = counted.groupBy("cell").agg(
        F.coalesce(F.max(F.when(F.col("own"), F.col("blocks"))), F.lit(0)).alias("own"),
        F.coalesce(F.max(F.when(~F.col("own"), F.col("blocks"))), F.lit(0)).alias("guests"),
    )
    at = F.pmod(F.xxhash64("cid", "cell"), F.when(at_home, F.col("own")).otherwise(F.col("guests"))).cast("int")
    rows = placed.join(F.broadcast(sizes), "cell").withColumn("at", at)  # at most MAX_CELLS rows
    key = lambda i, j, visit, side: F.struct(i.alias("i"), j.alias("j"), F.lit(visit).alias("visit"), side.alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here = F.col("at")
    among = F.transform(upto(F.col("own")), lambda k: key(F.least(here, k), F.greatest(here, k), False, F.when(here <= k, 0).otherwise(1)))
    hosts = F.transform(upto(F.col("guests")), lambda k: key(here, k, True, F.lit(0)))
    visits = F.transform(upto(F.col("own")), lambda k: key(k, here, True, F.lit(1)))
    dealt = F.when(at_home, F.concat(among, hosts)).otherwise(visits)
    kept = ["cell", "home", "cid", "m", "vector", "lower"]
    return rows.select(*kept, F.explode(dealt).alias("k")).select(*kept, "k.*")


def _met_before(group: pd.DataFrame, hosts: np.ndarray, guests: np.ndarray) -> np.ndarray:
    """(host, guest): whether they meet in the guest's home, which has the lower number, since the host visits it."""
    homes, of_guest = np.unique(group["home"].to_numpy()[guests], return_inverse=True)
    lower = group["lower"].to_numpy()[hosts]
    owner = np.repeat(np.arange(len(hosts)), [len(x) for x in lower])
    cells = np.concatenate(lower).astype(np.int64) if len(lower) else np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
    known = homes[place] == cells
    seen = np.zeros((len(hosts), len(homes)), dtype=bool)
    seen[owner[known], place[known]] = True
    return seen[:, of_guest]


def _compare(pairs: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b, n): per class a, either a number of linked vectors n, or a link b of a spanning forest."""

    def per_pair(group: pd.DataFrame) -> pd.DataFrame:
        cid, m, side = group["cid"].to_numpy(), group["m"].to_numpy(), group["side"].to_numpy()
        unit, size = _unit(group["vector"].tolist(), width), group["vector"].map(len).to_numpy()
        visit = bool(group["visit"].iloc[0])
        same = not visit and group["i"].iloc[0] == group["j"].iloc[0]
        one = np.arange(len(cid)) if same else np.flatnonzero(side == 0)
        two = one if same else np.flatnonzero(side == 1)
        close = (unit[one] @ unit[two].T >= least) & (size[one][:, None] == size[two][None, :])
        if same:
            np.fill_diagonal(close, False)
        if visit and close.any():
            close &= ~_met_before(group, one, two)
        counts = np.zeros(len(cid), dtype=np.int64)
        counts[one] += close @ m[two]
        if not same:
            counts[two] += close.T @ m[one]
        r, c = np.nonzero(close)
        r, c = one[r], two[c]
        root, last = np.arange(len(cid)), None
        while last is None or (root != last).any():
            last = root.copy()
            np.minimum.at(root, r, last[c])
            np.minimum.at(root, c, last[r])
            root = root[root]
        linked, tied = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(cid)))
        return pd.DataFrame(
            {
                "a": np.r_[cid[linked], cid[tied]],
                "b": pd.array([None] * len(linked) + cid[root[tied]].tolist(), dtype="Int64"),
                "n": pd.array(counts[linked].tolist() + [None] * len(tied), dtype="Int64"),
            }
        )

    return pairs.groupBy("cell", "i", "j", "visit").applyInPandas(per_pair, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, *, least: float = 0.9, margin: float | None = None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different length with each other.  ``n_links`` counts linked rows (copies
    included), ``component_id`` is the smallest vec_id reachable by links, ``kept`` marks its
    row.  A row without an id that links with nothing is kept.  Other columns are not read; an
    empty table gives an empty table.

    Links are exact in double precision, and none is lost.  With a ``margin``, vectors visit only cells whose
    centroid's cosine is within it of their best one: fewer copies, and a link between cells is found
    only if one of its vectors visits the other's home (see README for recall).
    """
    kind = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    rows = computed(rows, ok=usable(F.col("vector")), h1=F.xxhash64("vector"), h2=F.hash("vector"))
    grouped = rows.filter("ok").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = durable(grouped.withColumn("cid", F.monotonically_increasing_id()))
    shape = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    made = None
    if shape[0]:
        cells = max(1, min(MAX_CELLS, -(-shape[0] // CELL_ROWS)))
        centers = centroids(classes, shape[1], cells)
        made = durable(_compare(_block_pairs(durable(_placed(classes, centers, shape[1], least, margin))), shape[1], least))
        counts = made.filter("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
        roots = components(made.filter("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
        inside = classes.select("cid", "h1", "h2", "m", "least").join(counts, "cid", "left").join(roots, "cid", "left")
        inside = inside.withColumn("root", F.coalesce("root", "cid"))
        names = inside.groupBy("root").agg(F.min("least").alias("component"))
        labels = inside.join(names, "root").select("h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component")
    else:
        labels = classes.select("h1", "h2", F.lit(0).cast("long").alias("links"), F.col("least").alias("component"))
    keyed = rows.select("vec_id", "ok", F.when(F.col("ok"), F.col("h1")).alias("h1"), F.when(F.col("ok"), F.col("h2")).alias("h2"))
    met = lookup_join(keyed, labels, ["h1", "h2"], "left", by=["vec_id"], counts=classes.select("h1", "h2", F.col("m").alias("n")))
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id"))
    out = met.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
