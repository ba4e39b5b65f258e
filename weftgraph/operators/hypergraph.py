"""Facts to hyperedges, nodes and incidence, for all graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, strip


def edge_key(entities: Column, relation: Column, chunk_id: Column) -> Column:
    """Short id of a hyperedge. Rows are told apart by the key's columns themselves, not by this digest."""
    text = F.concat_ws("|", F.to_json(F.array_sort(entities)), relation, chunk_id)
    return F.concat(F.lit("edge_"), F.substring(F.md5(text), 1, 12))


def hyperedges(facts: DataFrame) -> DataFrame:
    """Hyperedges of (graph_id, chunk_idx, fact_pos, chunk_id, raw_entities, relation, sentence_index, confidence,
    sentences, gold_sentence_offsets) facts.

    Entities and relation are normalised; facts of fewer than two distinct
    entities go. Of facts in one chunk with the same relation and entities,
    repeats counted and order ignored, the first stays. edge_seq orders edges.
    """
    clean = facts.withColumn("entities", F.transform("raw_entities", normalize)).withColumn("relation", F.lower(strip(F.col("relation"))))
    clean = clean.filter(F.size(F.array_distinct("entities")) >= 2).withColumn("key", F.array_sort("entities"))
    first = Window.partitionBy("graph_id", "chunk_id", "relation", "key").orderBy("chunk_idx", "fact_pos")
    kept = clean.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    return kept.select(
        "graph_id",
        edge_key(F.col("entities"), F.col("relation"), F.col("chunk_id")).alias("edge_id"),
        F.struct("chunk_idx", "fact_pos").alias("edge_seq"),
        "entities",
        "raw_entities",
        "relation",
        "sentence_index",
        F.get("sentences", F.col("sentence_index")).alias("sentence"),
        "chunk_id",
        "confidence",
        F.array_contains("gold_sentence_offsets", F.col("sentence_index")).alias("is_gold"),
    )


def incidence(edges: DataFrame) -> DataFrame:
    """(graph_id, edge_id, edge_seq, chunk_id, pos, entity_id, raw_label), a row for each place in an edge."""
    places = F.posexplode(F.arrays_zip("entities", "raw_entities")).alias("pos", "e")
    return edges.select("graph_id", "edge_id", "edge_seq", "chunk_id", places).select(
        "graph_id", "edge_id", "edge_seq", "chunk_id", "pos", F.col("e.entities").alias("entity_id"), F.col("e.raw_entities").alias("raw_label")
    )


def _in_order(value: str) -> Column:
    """Distinct values in the order of their places."""
    ordered = F.array_sort(F.collect_list(F.struct("edge_seq", "pos", value)))
    return F.array_distinct(F.transform(ordered, lambda x: x[value]))


def nodes(places: DataFrame) -> DataFrame:
    """(graph_id, entity_id, label, chunks, edges): the label as first written; chunks and edges in order of mention."""
    return places.groupBy("graph_id", "entity_id").agg(
        F.min_by("raw_label", F.struct("edge_seq", "pos")).alias("label"), _in_order("chunk_id").alias("chunks"), _in_order("edge_id").alias("edges")
    )


def edges_for_entity(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, entity_id, edge columns) for each edge an entity is in; ids without an edge fall away."""
    own = places.select("graph_id", "entity_id", "edge_id").distinct()
    return own.join(edges, ["graph_id", "edge_id"])


def neighbors(places: DataFrame) -> DataFrame:
    """(graph_id, entity_id, neighbor): entities that share an edge."""
    a = places.select("graph_id", "edge_id", "entity_id").distinct()
    b = a.withColumnRenamed("entity_id", "neighbor")
    return a.join(b, ["graph_id", "edge_id"]).filter("entity_id <> neighbor").select("graph_id", "entity_id", "neighbor").distinct()


def graph_summary(edges: DataFrame) -> DataFrame:
    """(graph_id, nodes, edges, gold_edges, avg_arity); repeats in an edge count towards its arity."""
    per_edge = edges.select("graph_id", "edge_id", "is_gold", F.size("entities").alias("arity"), F.array_distinct("entities").alias("own"))
    counted = per_edge.groupBy("graph_id").agg(
        F.count("*").alias("edges"), F.count_if("is_gold").alias("gold_edges"), F.bround(F.sum("arity") / F.count("*"), 2).alias("avg_arity")
    )
    named = per_edge.select("graph_id", F.explode("own").alias("entity")).groupBy("graph_id").agg(F.count_distinct("entity").alias("nodes"))
    return counted.join(named, "graph_id").select("graph_id", "nodes", "edges", "gold_edges", "avg_arity")


def snapped(facts: DataFrame, known: DataFrame, hits: DataFrame) -> DataFrame:
    """Entities of new facts tied to known nodes.

    facts: (graph_id, fact_id, pos, label). known: (graph_id, entity_id).
    hits: (graph_id, label, entity_id), what labels resolve to. An entity that is
    a node stays; one that resolves to a single node becomes it; any other keeps
    its own normal form. All facts see the nodes as they were before.
    """
    one = hits.groupBy("graph_id", "label").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("hit"))
    norm = facts.withColumn("norm", normalize(F.col("label")))
    exact = known.select("graph_id", F.col("entity_id").alias("norm"), F.lit(True).alias("exact")).distinct()
    joined = norm.join(exact, ["graph_id", "norm"], "left").join(one, ["graph_id", "label"], "left")
    entity = F.when(F.coalesce("exact", F.lit(False)), F.col("norm")).when(F.col("n") == 1, F.col("hit")).otherwise(F.col("norm"))
    return joined.select("graph_id", "fact_id", "pos", "label", entity.alias("entity"), (entity != F.col("norm")).alias("snapped"))
