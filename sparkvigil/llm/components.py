"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _largest(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the least node in the node's neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    moved = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, move to the node's least neighbour. Edges run from a to a smaller b."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root), root being the least node of the component.

    Alternates the large-star and small-star steps; every node that has a link is
    returned, its root included. Hot nodes meet only partial aggregates and
    joins of two shuffled sides, which adaptive execution may split. Links to
    itself or with a null end are ignored; an empty table gives an empty one.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now, "edges")
    while not now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() or _forks(now):
        now = cut(_smallest(cut(_largest(now), "edges")), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("root")))


def _forks(edges: DataFrame) -> bool:
    """Whether some node still points at two others."""
    return not edges.groupBy("a").count().where("count > 1").isEmpty()
