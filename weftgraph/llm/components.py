"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    tied = both.filter("v > u").join(least, F.col("u") == F.col("of"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. In: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least.select(F.col("u").alias("of"), "m"), F.col("u") == F.col("of"))
    return (
        tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        .unionAll(least.select("u", F.col("m").alias("v"))).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `links` (a, b): the least node that links lead to.

    A node that is the least itself has a row as well. The number of rounds
    grows with the logarithm of a component's size; each is checkpointed.
    Rows with a = b only name a node.
    """
    edges = packed(cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()))
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = print_of(edges)
    while last[0]:
        edges = packed(cut(_small_star(_large_star(edges))))
        now = print_of(edges)
        if now == last:
            break
        last = now
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return named.unionAll(roots)
