"""The flows from questions to verdicts, evidence and repairs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import audit, components, facts, hypergraph, projection, repair, resolve, retrieve, rowwise
from ..operators.shared import cut, if_small, stored

#: What audit_chains and reports read of a sample.
READY = ("graph_id", "hop_type", "end", "entities", "titles", "neighbours")


class Graph:
    """The tables of all graphs of a corpus; made by `graph_of`. What follows from edges is worked out when it is asked for."""

    def __init__(self, edges: DataFrame, chunks: DataFrame):
        self.edges, self.chunks = edges, chunks

    @cached_property
    def places(self) -> DataFrame:
        return hypergraph.incidence(self.edges)

    @cached_property
    def nodes(self) -> DataFrame:
        return hypergraph.nodes(self.places)

    @cached_property
    def pairs(self) -> DataFrame:
        return stored(projection.linked_pairs(self.edges))

    @cached_property
    def parts(self) -> DataFrame:
        return components.components(self.pairs)

    def neighbours(self) -> DataFrame:
        both = projection.both_ways(self.pairs)
        return both.select("graph_id", F.col("src").alias("entity_id"), F.col("dst").alias("neighbor"))

    def provenance(self) -> DataFrame:
        return resolve.title_entities(self.places, self.chunks)

    def only(self, ids: DataFrame) -> Graph:
        """The graphs of these (graph_id) rows."""
        return Graph(self.edges.join(ids, "graph_id", "left_semi"), self.chunks.join(ids, "graph_id", "left_semi"))


def graph_of(edges: DataFrame, chunks: DataFrame) -> Graph:
    """A graph whose edges are stored first, as all that follows reads them several times."""
    return Graph(stored(edges), chunks)


def extracted_edges(chunks: DataFrame, extractor) -> tuple[DataFrame, DataFrame]:
    """(edges, parse failures by graph) of chunks, equal chunks extracted once."""
    answered = facts.with_content(chunks, facts.extract(chunks, extractor))
    checked = cut(facts.checked_facts(answered.select("chunk_id", "raw", "sentences")))
    typed = facts.facts_from(checked).join(
        chunks.select("graph_id", "chunk_id", "chunk_idx", "sentences", "gold_sentence_offsets"), "chunk_id"
    )
    return hypergraph.hyperedges(typed), facts.parse_failures(checked, answered)


def audit_reports(samples: DataFrame, graph: Graph, semantic: bool = False, most: int = rowwise.ROW_PLACES) -> tuple[DataFrame, DataFrame]:
    """(reports, chains) of (graph_id, answer, hop_type, gold, question_entities, parse_failures) samples."""
    ready = stored(_joined(samples, graph, semantic)) if semantic else _prepared(samples, graph, most)
    chains = stored(audit.audit_chains(ready))
    return audit.reports(samples, ready, chains), chains


def _joined(samples: DataFrame, graph: Graph, semantic: bool = False) -> DataFrame:
    """What the audit looks at, by joins: for graphs of any size."""
    asked = samples.select("graph_id", F.explode("question_entities").alias("label")).unionByName(samples.select("graph_id", F.col("answer").alias("label")))
    titles = samples.select("graph_id", F.explode(F.transform("gold", lambda g: g["title"])).alias("title"))
    by_entity = stored(resolve.resolve_entities(asked, graph.nodes, semantic))
    by_title = stored(resolve.resolve_titles(titles, graph.nodes, graph.provenance(), semantic))
    return audit.prepared(samples, graph.chunks, by_entity, by_title, graph.parts, graph.neighbours()).select(*READY)


def _prepared(samples: DataFrame, graph: Graph, most: int) -> DataFrame:
    """What the audit looks at: graphs of up to `most` places in their rows, larger ones by joins."""
    ready = stored(rowwise.prepared(samples, graph.edges, graph.chunks, most))
    small, large = ready.filter(F.col("size") <= most).select(*READY), ready.filter(F.col("size") > most).select("graph_id")
    if large.isEmpty():
        return small
    return small.unionByName(stored(_joined(samples.join(large, "graph_id", "left_semi"), graph.only(large))))


def shown_paths(edges: DataFrame, ends: DataFrame, most: int = rowwise.ROW_PLACES) -> DataFrame:
    """(graph_id, src, dst, pos, from_node, to_node, edge_id, edge_seq): the hops of a shortest path for each (graph_id, src, dst) row that has one.

    As components.path_edges; graphs of up to `most` places in their rows, larger ones round by round.
    """
    made = stored(rowwise.path_edges(edges, ends, most).filter((F.col("size") > most) | (F.size("hops") > 0)))
    hops, large = made.filter(F.col("size") <= most).select("graph_id", F.inline("hops")), made.filter(F.col("size") > most).select("graph_id")
    if large.isEmpty():
        return hops
    own = stored(edges.join(large, "graph_id", "left_semi"))
    nodes = components.path_nodes(stored(projection.linked_pairs(own)), ends.join(large, "graph_id", "left_semi"))
    walked = components.path_edges(nodes, projection.best_edge(own)).join(own.select("graph_id", "edge_id", "edge_seq"), ["graph_id", "edge_id"])
    return hops.unionByName(walked.select(*hops.columns))


def names_of(labels: DataFrame, graph: Graph, semantic: bool = False) -> DataFrame:
    """(graph_id, norm, entity_id): names as entities, or else as titles."""
    as_title = labels.withColumnRenamed("label", "title")
    return resolve.resolve_names(
        resolve.resolve_entities(labels, graph.nodes, semantic), resolve.resolve_titles(as_title, graph.nodes, graph.provenance(), semantic)
    )


def _reads(targets: DataFrame, graph: Graph, most_chunks: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(ends, read) of targets, see repair.endpoints and repair.source_chunks; graphs of up to `most` places in their rows, larger ones by joins."""
    made = stored(rowwise.reads(targets, graph.edges, graph.chunks, most_chunks, most))
    each = made.filter(F.col("size") <= most).select("graph_id", F.inline("targets"))
    ends = each.drop("read")
    read = each.select("graph_id", "target_pos", F.inline("read")).drop("title")
    large = made.filter(F.col("size") > most).select("graph_id")
    if large.isEmpty():
        return ends, read
    own, rest = targets.join(large, "graph_id", "left_semi"), graph.only(large)
    labels = own.select("graph_id", F.explode(F.concat("src_options", "dst_options")).alias("label")).distinct()
    names = stored(names_of(labels, rest))
    joined = stored(repair.endpoints(own, names))
    more = repair.source_chunks(joined, names, rest.places, rest.chunks, most_chunks).select(*read.columns)
    return ends.unionByName(joined.select(*ends.columns)), stored(read.unionByName(more))


def repaired(
    samples: DataFrame, graph: Graph, chains: DataFrame, extractor, most_chunks: int = repair.MAX_CHUNKS, snap: bool = True, most: int = rowwise.ROW_PLACES
) -> tuple[DataFrame, DataFrame]:
    """(attempts, edges): what came of each target, and the edges before with those found."""
    targets = stored(repair.repair_targets(samples, chains))
    ends, read = _reads(targets, graph, most_chunks, most)
    asks = read.join(ends.select("graph_id", "target_pos", "src", "dst"), ["graph_id", "target_pos"]).select(
        F.to_json(F.struct("graph_id", "target_pos", "chunk_id")).alias("ask_id"), "graph_id", "target_pos", "chunk_id", "chunk_idx", "sentences",
        "gold_sentence_offsets", "src", "dst", F.concat(F.lit("connect "), "src", F.lit(" to "), "dst").alias("goal"),
    )
    raw = facts.extract_targeted(asks, extractor)
    checked = facts.checked_facts(asks.join(raw, "ask_id").select(F.col("ask_id").alias("chunk_id"), "raw", "sentences"))
    typed = stored(facts.facts_from(checked).withColumnRenamed("chunk_id", "ask_id").join(asks.drop("src", "dst", "goal"), "ask_id"))
    # only graphs for which facts came back have edges to compare with and nodes to tie them to
    some = not typed.isEmpty()
    known = graph.only(if_small(typed.select("graph_id").distinct()))
    if snap and some:
        each = typed.select("graph_id", F.struct("ask_id", "fact_pos").alias("fact_id"), F.posexplode("raw_entities").alias("pos", "label"))
        hits = resolve.resolve_entities(each.select("graph_id", "label").distinct(), known.nodes)
        hits = each.select("graph_id", "label").distinct().withColumn("norm", normalize(F.col("label"))).join(hits, ["graph_id", "norm"]).select("graph_id", "label", "entity_id")
        tied = hypergraph.snapped(each, known.nodes.select("graph_id", "entity_id"), hits)
        tied = tied.groupBy("graph_id", "fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda x: x["entity"]).alias("tied"))
        typed = typed.withColumn("fact_id", F.struct("ask_id", "fact_pos")).join(tied, ["graph_id", "fact_id"]).withColumn("raw_entities", F.col("tied")).drop("tied", "fact_id")
    # places after those of the first extraction, in the order of targets
    order = F.expr("1000000 * (1 + target_pos) + chunk_idx").cast("int")
    found = hypergraph.hyperedges(typed.withColumn("chunk_idx", order))
    fresh = stored(repair.new_edges(found, known.edges if some else found))
    added = fresh.select("graph_id", (F.expr("edge_seq.chunk_idx div 1000000") - 1).cast("int").alias("target_pos"))
    return repair.attempts(ends, read, added), graph.edges.unionByName(fresh) if some else graph.edges


def scored_walks(samples: DataFrame, edges: DataFrame, starts: DataFrame, most: int = rowwise.ROW_PLACES) -> tuple[DataFrame, DataFrame]:
    """(scored, near): the edges that a walk from (graph_id, entity_id) starts can meet, see retrieve.scored_edges, and those of the neighbourhood.

    A guided walk reads no edge beyond GUIDED_HOPS rounds, so the others aren't
    scored. Graphs of up to `most` places are walked and scored in their rows, of
    larger ones every edge is scored.
    """
    columns = ("graph_id", "edge_id", "edge_seq", "sentence", "entities", "score")
    made = stored(rowwise.met_edges(samples, edges, starts, retrieve.GUIDED_HOPS, most))
    met, large = made.filter(F.col("size") <= most).select("graph_id", F.inline("met")), made.filter(F.col("size") > most).select("graph_id")
    scored, near = met.select(*columns), met.filter(F.col("hop") <= retrieve.MAX_HOPS).select("graph_id", "edge_id")
    if large.isEmpty():
        return scored, near
    rest = stored(edges.join(large, "graph_id", "left_semi"))
    places = rest.select("graph_id", "edge_id", F.explode("entities").alias("entity_id"))
    more = stored(retrieve.khop_edges(starts.join(large, "graph_id", "left_semi"), places))
    return scored.unionByName(stored(retrieve.scored_edges(samples, rest).select(*columns))), near.unionByName(more)


def repair_validation(samples: DataFrame, graph: Graph, extractor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports before, reports after, attempts) of the repairable samples."""
    before, chains = audit_reports(samples, graph)
    before = cut(before.filter("is_repairable"))
    own = samples.join(before.select(F.col("sample_id").alias("graph_id")), "graph_id", "left_semi")
    broken = chains.join(own.select("graph_id"), "graph_id", "left_semi")
    tries, edges = repaired(own, graph, broken, extractor)
    after, _ = audit_reports(own, graph_of(edges, graph.chunks))
    return before, after, tries
