"""Connected components and hop counts of projected graphs, all graphs in each round."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(pair_rows: DataFrame) -> DataFrame:
    """(graph_id, node, component) for the ends of (graph_id, src, dst) rows; component is the least node reachable.

    Alternating stars: each round ties a node's larger neighbours to its least
    one, then the smaller ones, until no tie changes. Rounds are checkpointed
    and grow with the logarithm of a component's size.
    """
    ends = pair_rows.select("graph_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    loops, edges = ends.filter("u = v"), cut(ends.filter("u <> v"))
    seal = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("graph_id", "u", "v").cast("decimal(38,0)"))).first())
    last = seal(edges)
    while last[0]:
        both = edges.unionAll(edges.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("graph_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, ["graph_id", "u"]).select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        floor = large.groupBy("graph_id", "u").agg(F.min("v").alias("m"))
        small = large.join(floor, ["graph_id", "u"]).select("graph_id", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(small.unionAll(floor.select("graph_id", "u", F.col("m").alias("v"))).distinct())
        now = seal(edges)
        if now == last:
            break
        last = now
    tied = edges.select("graph_id", F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select("graph_id", F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select("graph_id", F.col("u").alias("node"), F.col("u").alias("component")).join(tied, ["graph_id", "node"], "left_anti")
    return tied.unionAll(roots.unionAll(alone).distinct())


def hop_counts(pair_rows: DataFrame, sources: DataFrame, max_hops: int | None = None, directed: bool = False) -> DataFrame:
    """(graph_id, source, node, hops) from (graph_id, source) rows, breadth first, until nothing new is met or `max_hops`. A source that isn't a node isn't found."""
    ahead = pair_rows.select("graph_id", "src", "dst")
    near = cut(ahead if directed else ahead.unionAll(pair_rows.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    known = near.select("graph_id", F.col("src").alias("source")).union(near.select("graph_id", F.col("dst").alias("source"))).distinct()
    seen = cut(sources.select("graph_id", "source").distinct().join(known, ["graph_id", "source"]).select("graph_id", "source", F.col("source").alias("node"), F.lit(0).alias("hops")))
    front, last = seen, seen.limit(0)
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        step = front.join(near, (front["graph_id"] == near["graph_id"]) & (front["node"] == near["src"]))
        step = step.select(front["graph_id"], "source", F.col("dst").alias("node")).distinct()
        # where links go both ways, a neighbour of the front is in it, in the front before, or new
        known = seen if directed else last.unionByName(front)
        last, front = front, cut(step.join(known, ["graph_id", "source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if directed and hop % 8 == 0 else seen.unionByName(front)
    return seen


def shortest_paths(pair_rows: DataFrame, wanted: DataFrame, directed: bool = False) -> DataFrame:
    """(graph_id, src, dst, path, found) for (graph_id, src, dst) rows; of equally short paths the first in node order.

    A graph is small (a sample), so one is searched in a task of its own; the
    path of a node to itself is that node.
    """
    import pandas as pd

    def search(links: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(links["src"], links["dst"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set())
            if not directed:
                near[b].add(a)
        near = {k: sorted(v) for k, v in near.items()}
        rows = []
        for src, own in asked.groupby("src"):
            back = {src: None} if src in near else {}
            line = list(back)
            while line:
                line = [b for a in line for b in near[a] if b not in back and not back.update({b: a})]
            for dst in own["dst"]:
                path, at = [], dst
                while at is not None and dst in back:
                    path.append(at)
                    at = back[at]
                rows.append((own["graph_id"].iloc[0], src, dst, path[::-1], bool(path)))
        return pd.DataFrame(rows, columns=["graph_id", "src", "dst", "path", "found"])

    kinds = dict(wanted.dtypes)
    schema = f"graph_id {kinds['graph_id']}, src {kinds['src']}, dst {kinds['dst']}, path array<{kinds['src']}>, found boolean"
    asked = wanted.select("graph_id", "src", "dst").distinct().toDF("graph_id", "src", "dst")  # new attributes
    return pair_rows.select("graph_id", "src", "dst").groupBy("graph_id").cogroup(asked.groupBy("graph_id")).applyInPandas(search, schema)


def path_nodes(pair_rows: DataFrame, wanted: DataFrame, directed: bool = False) -> DataFrame:
    """(graph_id, src, dst, pos, node): a shortest path for each (graph_id, src, dst) row that has one, from pos 0 on.

    Of equally short paths the one whose node before each is least, from the end
    on. All graphs are walked together: breadth first from the sources, then back
    from the ends, a round for each hop.
    """
    asked = cut(wanted.select("graph_id", "src", "dst").distinct())
    hops = cut(hop_counts(pair_rows, asked.select("graph_id", F.col("src").alias("source")), directed=directed))
    ahead = pair_rows.select("graph_id", F.col("src").alias("prev"), F.col("dst").alias("node"))
    near = ahead if directed else ahead.unionAll(pair_rows.select("graph_id", F.col("dst").alias("prev"), F.col("src").alias("node"))).distinct()
    ends = hops.select("graph_id", F.col("source").alias("src"), F.col("node").alias("dst"), F.col("hops").alias("pos"))
    at = cut(asked.join(ends, ["graph_id", "src", "dst"]).withColumn("node", F.col("dst")))
    out = at
    while not (left := at.filter("pos > 0")).isEmpty():
        step = left.join(near, ["graph_id", "node"]).withColumn("pos", F.col("pos") - 1)
        closer = hops.select("graph_id", F.col("source").alias("src"), F.col("node").alias("prev"), F.col("hops").alias("pos"))
        back = step.join(closer, ["graph_id", "src", "prev", "pos"]).groupBy("graph_id", "src", "dst", "pos").agg(F.min("prev").alias("node"))
        at = cut(back.select(*at.columns))
        out = out.unionByName(at)
    return out.select("graph_id", "src", "dst", "pos", "node")


def path_edges(nodes: DataFrame, edge_for: DataFrame) -> DataFrame:
    """(graph_id, src, dst, pos, from_node, to_node, edge_id, is_broken): the hops of `path_nodes` with the edge to show for each.

    edge_for: (graph_id, src, dst, edge_id) with src < dst, see projection.best_edge; a hop without one is broken.
    """
    start = nodes.select("graph_id", "src", "dst", (F.col("pos") + 1).alias("pos"), F.col("node").alias("from_node"))
    hops = start.join(nodes.withColumnRenamed("node", "to_node"), ["graph_id", "src", "dst", "pos"])
    shown = edge_for.select("graph_id", F.col("src").alias("low"), F.col("dst").alias("high"), "edge_id")
    hops = hops.withColumn("low", F.least("from_node", "to_node")).withColumn("high", F.greatest("from_node", "to_node"))
    hops = hops.join(shown, ["graph_id", "low", "high"], "left").drop("low", "high")
    return hops.select("graph_id", "src", "dst", "pos", "from_node", "to_node", "edge_id", F.col("edge_id").isNull().alias("is_broken"))


def best_ends(pair_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(graph_id, set_id, src, dst, hops): of all pairs of different nodes of two sets, the nearest, then the least.

    sets: (graph_id, set_id, side, node), side `from` or `to`. Sets without a path give no row.
    """
    start = sets.filter("side = 'from'").select("graph_id", "set_id", F.col("node").alias("src")).distinct()
    end = sets.filter("side = 'to'").select("graph_id", "set_id", F.col("node").alias("dst")).distinct()
    hops = hop_counts(pair_rows, start.select("graph_id", F.col("src").alias("source")))
    near = start.join(hops.select("graph_id", F.col("source").alias("src"), F.col("node").alias("dst"), "hops"), ["graph_id", "src"])
    best = near.join(end, ["graph_id", "set_id", "dst"]).filter("src <> dst").groupBy("graph_id", "set_id").agg(F.min(F.struct("hops", "src", "dst")).alias("b"))
    return best.select("graph_id", "set_id", "b.src", "b.dst", "b.hops")
