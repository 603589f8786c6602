"""Connected components of a link table, by alternating large and small stars.

Every vertex hands the smallest vertex it knows of to its larger neighbours, then to its
smaller ones (Kiveris et al., 2014), until each vertex points at the smallest of its component.
Edges are made durable after each step, so a lost executor re-reads one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import durable


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every vertex of ``links`` (a, b) that is not the smallest of its component.

    Self-links and repeated links do no harm.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = durable(edges.distinct())
    while True:
        edges = durable(_small_star(_large_star(edges)))
        if _all_stars(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every vertex either points once, at a vertex that points nowhere, or does not point at all."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("points")), F.struct(F.col("v").alias("x"), F.lit(0).alias("points")))).alias("e")).select("e.*")
    wrong = (F.sum("points") > 1) | ((F.sum("points") == 1) & (F.min("points") == 0))
    return ends.groupBy("x").agg(wrong.alias("wrong")).filter("wrong").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Repeated edges may come out; the small stars take them away."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    passed = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    return passed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
