"""Projection of hyperedges to pairs, and the health of the projected graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut


def clique(entities: Column) -> Column:
    """All pairs of an edge's distinct entities, in listing order. An edge has few entities, so this stays in the row."""
    own = F.array_distinct(entities)
    pairs = F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(pairs)


def pairs(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(graph_id, src, dst, edge_ids, is_gold): pairs of entities, with the edges behind them in order.

    Undirected pairs have src < dst; directed ones keep the listing order. A
    pair is gold if one of its edges is.
    """
    each = edges.select("graph_id", "edge_id", "edge_seq", "is_gold", F.explode(clique(F.col("entities"))).alias("p"))
    ends = ("p.a", "p.b") if directed else (F.least("p.a", "p.b"), F.greatest("p.a", "p.b"))
    named = each.select("graph_id", *(F.col(e).alias(n) if isinstance(e, str) else e.alias(n) for e, n in zip(ends, ("src", "dst"), strict=True)), "edge_id", "edge_seq", "is_gold")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", "edge_id"))), lambda x: x["edge_id"])
    return named.groupBy("graph_id", "src", "dst").agg(ordered.alias("edge_ids"), F.bool_or("is_gold").alias("is_gold"))


def linked_pairs(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(graph_id, src, dst) of `pairs`, without the edges behind them."""
    each = edges.select("graph_id", F.explode(clique(F.col("entities"))).alias("p"))
    ends = (F.col("p.a"), F.col("p.b")) if directed else (F.least("p.a", "p.b"), F.greatest("p.a", "p.b"))
    return each.select("graph_id", ends[0].alias("src"), ends[1].alias("dst")).distinct()


def best_edge(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(graph_id, src, dst, edge_id): the edge to show for a hop: gold first, then most entities, then the earliest."""
    each = edges.select("graph_id", "edge_id", "edge_seq", "is_gold", F.size("entities").alias("arity"), F.explode(clique(F.col("entities"))).alias("p"))
    src, dst = (F.col("p.a"), F.col("p.b")) if directed else (F.least("p.a", "p.b"), F.greatest("p.a", "p.b"))
    order = F.struct(~F.col("is_gold"), -F.col("arity"), F.col("edge_seq"))
    return each.groupBy("graph_id", src.alias("src"), dst.alias("dst")).agg(F.min_by("edge_id", order).alias("edge_id"))


def both_ways(pair_rows: DataFrame) -> DataFrame:
    """(graph_id, src, dst) in either direction."""
    ahead = pair_rows.select("graph_id", "src", "dst")
    return ahead.unionAll(pair_rows.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def graph_stats(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(graph_id, nodes, projected_edges, hyperedges, avg_degree, max_arity, self_loops, components, density).

    Components aren't counted for directed graphs (null).
    """
    linked = cut(linked_pairs(edges, directed))
    own = edges.select("graph_id", "edge_id", F.array_distinct("entities").alias("own"))
    named = own.select("graph_id", F.explode("own").alias("node")).groupBy("graph_id").agg(F.count_distinct("node").alias("nodes"))
    arity = own.groupBy("graph_id").agg(F.count("*").alias("hyperedges"), F.max(F.size("own")).alias("max_arity"))
    links = linked.groupBy("graph_id").agg(
        F.count("*").alias("projected_edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops")
    )
    out = named.join(arity, "graph_id").join(links, "graph_id", "left").na.fill(0, ["projected_edges", "self_loops"])
    if directed:
        out = out.withColumn("components", F.lit(None).cast("long"))
    else:
        parts = components(linked).groupBy("graph_id").agg(F.count_distinct("component").alias("components"))
        out = out.join(parts, "graph_id", "left")
    n, m = F.col("nodes"), F.col("projected_edges")
    dense = F.when(n > 1, (1 if directed else 2) * m / (n * (n - 1))).otherwise(F.lit(0.0))
    return out.select(
        "graph_id", "nodes", "projected_edges", "hyperedges", F.bround(2 * m / F.greatest(n, F.lit(1)), 2).alias("avg_degree"),
        "max_arity", "self_loops", "components", F.bround(dense, 4).alias("density"),
    )
