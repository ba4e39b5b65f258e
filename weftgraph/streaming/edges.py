"""Hyperedges from a stream of facts.

Each fact becomes an edge as it comes; of facts with one key within the
watermark the first to arrive stays, across batches. Edge counts by window
follow the same watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, strip
from ..operators.hypergraph import edge_key


def stream_edges(facts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Edges of streaming (graph_id, chunk_id, raw_entities, relation, at) rows."""
    clean = facts.withColumn("entities", F.transform("raw_entities", normalize)).withColumn("relation", F.lower(strip(F.col("relation"))))
    clean = clean.filter(F.size(F.array_distinct("entities")) >= 2)
    keyed = clean.withColumn("edge_id", edge_key(F.col("entities"), F.col("relation"), F.col("chunk_id"))).withColumn("key", F.array_sort("entities"))
    once = keyed.withWatermark("at", late).dropDuplicatesWithinWatermark(["graph_id", "chunk_id", "relation", "key"])
    return once.select("graph_id", "edge_id", "entities", "relation", "chunk_id", "at")


def edge_counts(edges: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, graph_id, edges) by tumbling window of `at`; give `late` unless the rows have a watermark already."""
    own = edges.withWatermark("at", late) if late else edges
    counted = own.groupBy(F.window("at", width), "graph_id").agg(F.count("*").alias("edges"))
    return counted.select(F.col("window.start").alias("start"), "graph_id", "edges")
