"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.session import discard, in_tasks, materialize


def _large_star(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is linked to the smallest node the node sees."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = materialize(in_tasks(least, 2 * n), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    down = edges.where("a > b")
    least = materialize(in_tasks(down.groupBy("a").agg(F.min("b").alias("m")), n), "least")
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct(), least


def _links_and_loose(edges: DataFrame) -> tuple[int, int]:
    """How many links there are, and how many nodes keep them from being one star per component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    # a node of a star is its centre, or has one link, to the centre
    loose = (F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)
    row = nodes.agg(F.sum("up").alias("links"), F.count_if(loose).alias("loose")).first()
    return row["links"] or 0, row["loose"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Alternating large and small stars until the edges are one star per component: the number of
    rounds follows the logarithm of the longest path, each round is two aggregations and two joins,
    and its edges are written, so a lost executor costs one round. Tasks and files follow the number of links. A node with very many links
    is one key only of joins that adaptive execution can split and of pre-aggregated minima.
    Self-links and repeated edges are fine; an edge with a null is dropped.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    # one direction, so that a star's links all lead to its centre
    # and minima are written, so that each join has exchanges of its own, which skew handling can split
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, loose = _links_and_loose(edges)
    while loose:
        used = [edges]
        for star in (_large_star, _small_star):
            moved, least = star(edges, n)
            # a star has a row for each link it is given; the small one a row more for each node
            edges = materialize(in_tasks(moved, 2 * n), "stars")
            used += [least, edges]
        discard(*used[:-1])
        n, loose = _links_and_loose(edges)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(in_tasks(stars.select(F.col("component").alias("node"), "component").distinct(), n))
