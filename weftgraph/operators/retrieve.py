"""Evidence for a question: sentences by similarity, a k-hop neighbourhood, or a beam walked towards the question."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .rowwise import in_rows, lists
from .vectors import cosine, encode, hashing_encoder, top_k

TOP_K, MAX_HOPS, OVERRETRIEVE = 8, 2, 20
GUIDED_HOPS, BEAM, GUIDED_MIN = 5, 4, 0.15


def text_evidence(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, encoder=hashing_encoder) -> DataFrame:
    """(graph_id, rank, sentence, sim): the k sentences of a graph nearest to its question, negatives dropped.

    Sentences are stripped, blanks dropped, and repeats taken at their first place.
    """
    each = chunks.select("graph_id", "chunk_idx", F.posexplode("sentences").alias("pos", "s")).withColumn("sentence", strip(F.col("s")))
    once = each.filter("sentence <> ''").groupBy("graph_id", "sentence").agg(F.min(F.struct("chunk_idx", "pos")).alias("place"))
    items = once.select("graph_id", F.struct("place", "sentence").alias("item"), encode(F.col("sentence"), encoder).alias("vector"))
    # a question may be a whole document: its digest stands for it in the rows of its sentences
    asked = questions.select("graph_id", F.sha2("question", 256).alias("query"), encode(F.col("question"), encoder).alias("vector"))
    return top_k(asked, items, k, 0.0).select("graph_id", "rank", F.col("item.sentence").alias("sentence"), "sim")


def khop_edges(starts: DataFrame, places: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(graph_id, edge_id): edges met while walking `hops` rounds from (graph_id, entity_id) starts."""
    places = places.select("graph_id", "edge_id", "entity_id").distinct()
    front = seen = starts.select("graph_id", "entity_id").distinct()
    met = None
    for hop in range(hops):
        own = front.join(places, ["graph_id", "entity_id"]).select("graph_id", "edge_id").distinct()
        met = own if met is None else met.union(own)
        if hop + 1 < hops:
            beyond = own.join(places, ["graph_id", "edge_id"]).select("graph_id", "entity_id").distinct()
            front = beyond.join(seen, ["graph_id", "entity_id"], "left_anti")
            seen = seen.union(front)
    return met.distinct()


def scored_edges(questions: DataFrame, edges: DataFrame, encoder=hashing_encoder) -> DataFrame:
    """(graph_id, edge_id, edge_seq, sentence, entities, score): each edge's sentence against its graph's question."""
    # where sizes are estimated a vector counts as one number: without the hint, vectors of any number of questions would be broadcast
    asked = questions.select("graph_id", encode(F.col("question"), encoder).alias("q")).hint("merge")
    own = edges.select("graph_id", "edge_id", "edge_seq", "sentence", "entities", encode(F.coalesce("sentence", F.lit("")), encoder).alias("v"))
    return own.join(asked, "graph_id").select("graph_id", "edge_id", "edge_seq", "sentence", "entities", cosine(F.col("q"), F.col("v")).alias("score"))


def _distinct_sentences(ranked: DataFrame, k: int) -> DataFrame:
    """The first k different sentences in the order of (graph_id, place, sentence, score)."""
    once = ranked.groupBy("graph_id", "sentence").agg(F.min("place").alias("place"), F.min_by("score", "place").alias("sim"))
    order = Window.partitionBy("graph_id").orderBy("place")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("graph_id", "rank", "sentence", "sim")


def graph_evidence(scored: DataFrame, near: DataFrame, k: int = TOP_K, over: int = OVERRETRIEVE) -> DataFrame:
    """(graph_id, rank, sentence, sim): of the edges in `near`, the best k * over, then their first k different sentences."""
    own = scored.join(near, ["graph_id", "edge_id"])
    order = Window.partitionBy("graph_id").orderBy(F.col("score").desc(), "edge_seq")
    ranked = own.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k * over).filter("score >= 0")
    return _distinct_sentences(ranked, k)


def beam_search(
    scored: DataFrame, starts: DataFrame, hops: int = GUIDED_HOPS, beam: int = BEAM, least: float = GUIDED_MIN
) -> DataFrame:
    """(graph_id, place, edge_id, score): edges in the order of falling score and id, collected by a guided walk.

    A round lists the unseen edges of each node of the frontier, so an edge that
    two of them share stands twice; the best `beam` by score, then id, are cut
    off first, and those under `least` dropped after. The next frontier is what
    the chosen edges newly reach. One graph, a sample, is walked in one task.
    """

    def walk(edges: list[tuple], own: list) -> list[tuple]:
        score, members, at = {}, {}, {}
        for edge, value, names in edges:
            score[edge], members[edge] = value, names
            for name in dict.fromkeys(names):
                at.setdefault(name, []).append(edge)
        front, seen, taken = sorted(set(own)), set(), []
        visited = set(front)
        for _ in range(hops):
            open_edges = [(score[e], e) for node in front for e in at.get(node, ()) if e not in seen]
            chosen = [c for c in sorted(open_edges, reverse=True)[:beam] if c[0] >= least]
            if not chosen:
                break
            front = []
            for value, edge in chosen:
                seen.add(edge)
                taken.append((value, edge))
                fresh = [n for n in dict.fromkeys(members[edge]) if n not in visited]
                visited.update(fresh)
                front += fresh
        return sorted(taken, reverse=True)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = zip(lists(batch.column("items"), 0, 1, 2), batch.column("starts").to_pylist(), strict=True)
        taken = [[{"place": i, "edge_id": e, "score": s} for i, (s, e) in enumerate(walk(list(zip(*edges, strict=True)), own))] for edges, own in rows]
        return {"taken": pa.array(taken, pa.list_(pa.struct([("place", pa.int64()), ("edge_id", pa.string()), ("score", pa.float64())])))}

    edges = scored.groupBy("graph_id").agg(F.collect_list(F.struct("edge_id", "score", "entities")).alias("items"))
    own = starts.groupBy("graph_id").agg(F.collect_list("entity_id").alias("starts"))
    made = in_rows(edges.join(own, "graph_id"), work, "taken array<struct<place:long,edge_id:string,score:double>>", ["items", "starts"])
    return made.select("graph_id", F.inline("taken"))


def guided_evidence(scored: DataFrame, starts: DataFrame, k: int = TOP_K, **walk) -> DataFrame:
    """(graph_id, rank, sentence, sim) of a beam's edges."""
    found = beam_search(scored, starts, **walk).join(scored.select("graph_id", "edge_id", "sentence"), ["graph_id", "edge_id"])
    return _distinct_sentences(found, k)


def contexts(questions: DataFrame, by_condition: dict[str, DataFrame]) -> DataFrame:
    """(graph_id, condition, facts): the evidence of each condition in rank order; closed_book and empty ones have none."""
    out = questions.select("graph_id", F.lit("closed_book").alias("condition"), F.array().cast("array<string>").alias("facts"))
    for condition, evidence in by_condition.items():
        listed = evidence.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]).alias("facts"))
        own = questions.select("graph_id").join(listed, "graph_id", "left")
        out = out.unionByName(own.select("graph_id", F.lit(condition).alias("condition"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts")))
    return out
