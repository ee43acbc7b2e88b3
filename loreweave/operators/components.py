"""Connected components of a table of links, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.session import delete_tables, store_table


def _settled(edges: DataFrame) -> bool:
    """Whether every link leads from a node with one parent to a node with none."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def _star(pairs: DataFrame, larger_only: bool) -> tuple[DataFrame, list[str]]:
    """Every neighbour of a node is linked to the least of the node and its neighbours.

    Minima are partial aggregates; they are stored, so that both sides of the join that follows are plain exchanges and a hub
    is split over tasks.
    """
    least, p1 = store_table(pairs.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
    joined = pairs.join(least, F.col("a") == F.col("n"))
    moved = joined.filter(F.col("b") > F.col("a") if larger_only else F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        moved = moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    out, p2 = store_table(moved.filter(F.col("a") != F.col("b")).distinct())
    return out, [p1, p2]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id reachable.

    Each round hangs the larger neighbours of every node on its least neighbour and then the smaller ones, until all
    links lead straight to a root; the number of rounds grows with the logarithm of the links. Null ids and links of a node to
    itself are ignored.
    """
    spark = links.sparkSession
    pair = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter(F.col("a") != F.col("b"))
    edges, path = store_table(pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    old = [path]
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, used = _star(both, larger_only=True)
        edges, more = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger_only=False)
        delete_tables(spark, *old, *used, more[0])
        old = [more[1]]
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
