"""Small graphs, each worked on in a row of its own, so that nothing is shuffled but what gathers them.

A graph of more than ROW_PLACES places in edges, or chunks, isn't gathered: its
row has the size and empty lists, and is left to the joins of the other operators.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import grounded, normalize
from .audit import SET, empty, no_set
from .resolve import MIN_FUZZY_LENGTH
from .vectors import hashing_encoder

ROW_PLACES = 20_000
#: Sentences that are encoded and scored at once.
SCORED = 2_048
#: White space as `(?U)\s` has it; Python's own has four control characters more.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SET_TYPE = pa.struct([("entities", pa.list_(pa.string())), ("parts", pa.list_(pa.struct([(n, pa.string()) for n in ("component", "lo", "hi")])))])


def gathered(rows: DataFrame, value: Column, weight: Column, most: int, *more: Column) -> DataFrame:
    """(graph_id, size, items, ..): a row a graph, its items listed if their weights sum to `most` or less."""
    sized = rows.withColumn("_size", F.sum(weight).over(Window.partitionBy("graph_id")))
    listed = F.collect_list(F.when(F.col("_size") <= most, value))
    return sized.groupBy("graph_id").agg(F.max("_size").alias("size"), listed.alias("items"), *more)


def lists(column: pa.Array, *fields: int) -> Iterator[tuple[list, ...]]:
    """The named fields of a column of lists of structs, as Python lists, row by row; null is empty."""
    flat = column.flatten()
    values = [flat.field(k).to_pylist() for k in fields]
    at = 0
    for n in column.value_lengths().to_pylist():
        yield tuple(v[at : at + (n or 0)] for v in values)
        at += n or 0


def in_rows(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str, drop: list[str]) -> DataFrame:
    """`df` without the columns in `drop`, and with those that `work` makes of each batch; added: their schema."""
    kept = [f for f in df.schema if f.name not in drop]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.values()], names=[*names, *made])

    return df.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(added)]))


def _tokens(text: str) -> set[str]:
    return {t for t in SPACE.split(text) if t}


def components_of(edges: list[list]) -> dict[str, str]:
    """The least node reachable from each node; null names are no nodes."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while (up := root[x]) != x:
            root[x] = up = root[up]
            x = up
        return x

    for names in edges:
        least = None
        for name in names:
            if name is None:
                continue
            own = find(name) if name in root else root.setdefault(name, name)
            if least is None:
                least = own
            elif own < least:
                root[least] = least = own
            else:
                root[own] = least
    return {x: find(x) for x in root}


class Names:
    """What the names in one graph resolve to, as resolve_entities and resolve_titles have it without vectors.

    edge_chunks, edges: chunk id and entities of each edge; chunk_ids, chunk_titles: id and normalised title of each chunk.
    """

    def __init__(self, edges: list[list], edge_chunks: list, chunk_ids: list, chunk_titles: list, titles: list, nodes, min_length: int = MIN_FUZZY_LENGTH):
        self.nodes, self.min_length = nodes, min_length
        self.words: dict[str, set[str]] = {}
        wanted = {t for t in titles if t}
        by_chunk: dict = {}
        for chunk, title in zip(chunk_ids, chunk_titles, strict=True):
            if title in wanted and chunk is not None:
                by_chunk.setdefault(chunk, set()).add(title)
        self.named: dict[str, set] = {}
        for chunk, names in zip(edge_chunks, edges, strict=True):
            for title in by_chunk.get(chunk, ()):
                self.named.setdefault(title, set()).update(names)

    def _fuzzy(self, norm: str, either: bool) -> list[str]:
        if not self.words:
            self.words = {n: _tokens(n) for n in self.nodes if len(n) >= self.min_length}
        own = _tokens(norm)
        return [n for n, t in self.words.items() if t & own and (t <= own or either and own <= t)]

    def as_entity(self, norm: str | None) -> list[str]:
        if not norm:
            return []
        return [norm] if norm in self.nodes else self._fuzzy(norm, True) if len(norm) >= self.min_length else []

    def as_title(self, norm: str | None) -> list:
        """Null is among them where an edge of the title's chunks holds it."""
        if norm is None:
            return []
        own = self.named.get(norm, set()) | ({norm} if norm in self.nodes else set())
        return list(own) if own else self._fuzzy(norm, False)


def node_set(nodes: list[str], part: dict[str, str]) -> dict:
    """Sorted nodes as a set of audit.node_sets."""
    ends: dict[str, list[str]] = {}
    for n in nodes:
        ends.setdefault(part[n], [n, n])[1] = n
    return {"entities": nodes, "parts": [{"component": c, "lo": lo, "hi": hi} for c, (lo, hi) in sorted(ends.items())]}


def met_titles(edges: list[list], asked: list, titles: list, title_nodes: list[list[str]]) -> list[dict]:
    """(entity, title) pairs of norms where a neighbour of the one belongs to the other."""
    out = []
    for entity in dict.fromkeys(a for a in asked if a is not None):
        near: set = set()
        for names in edges:
            if entity in names:
                # the pair of a name and null is the name's with itself
                near.update(n for n in names if n is not None and (n != entity or None in names))
        out += [{"entity": entity, "title": t} for t, nodes in dict(zip(titles, title_nodes, strict=True)).items() if t is not None and not near.isdisjoint(nodes)]
    return out


def _resolved_batch(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    rows = zip(
        lists(batch.column("edge_items"), 0, 1), lists(batch.column("chunk_items"), 0, 1), batch.column("asked").to_pylist(),
        batch.column("answer_norm").to_pylist(), batch.column("title_norms").to_pylist(), strict=True,
    )
    entity_sets, title_sets, neighbours = [], [], []
    for (edge_chunks, edges), (chunk_ids, chunk_titles), asked, answer, titles in rows:
        part = components_of(edges)
        names = Names(edges, edge_chunks, chunk_ids, chunk_titles, titles, part)
        by_entity = [sorted(names.as_entity(n)) for n in (*asked, answer)]
        by_title = [sorted(n for n in names.as_title(t) if n is not None) for t in titles]
        entity_sets.append([node_set(n, part) for n in by_entity])
        title_sets.append([node_set(n, part) for n in by_title])
        neighbours.append(met_titles(edges, asked, titles, by_title))
    pairs = pa.list_(pa.struct([("entity", pa.string()), ("title", pa.string())]))
    return {
        "entity_sets": pa.array(entity_sets, pa.list_(SET_TYPE)), "title_sets": pa.array(title_sets, pa.list_(SET_TYPE)),
        "neighbours": pa.array(neighbours, pairs),
    }


def prepared(samples: DataFrame, edges: DataFrame, chunks: DataFrame, most: int = ROW_PLACES) -> DataFrame:
    """As audit.prepared, straight from edges and chunks, and the size of each graph; those of more than `most` aren't judged."""
    by_edge = gathered(edges.select("graph_id", "chunk_id", "entities"), F.struct("chunk_id", "entities"), F.size("entities"), most)
    said = chunks.select("graph_id", "chunk_id", "title", "sentences").join(samples.select("graph_id", "answer"), "graph_id")
    found = F.bool_or(grounded(F.col("answer"), F.col("sentences"))).alias("grounded")
    by_chunk = gathered(said, F.struct("chunk_id", normalize(F.col("title")).alias("title")), F.lit(1), most, found)
    none = empty("string")
    labels = F.transform(F.array_sort("gold"), lambda g: g["title"])
    rows = samples.select(
        "graph_id", "answer", "hop_type", "question_entities", labels.alias("titles"), normalize(F.col("answer")).alias("answer_norm"),
        F.coalesce(F.transform("question_entities", normalize), none).alias("asked"), F.coalesce(F.transform(labels, normalize), none).alias("title_norms"),
    )
    rows = rows.join(by_edge.withColumnsRenamed({"items": "edge_items", "size": "places"}), "graph_id", "left")
    rows = rows.join(by_chunk.withColumnRenamed("items", "chunk_items"), "graph_id", "left")
    rows = rows.withColumn("size", F.coalesce(F.greatest("places", "size"), F.lit(0).cast("long"))).drop("places")
    made = in_rows(
        rows, _resolved_batch, f"entity_sets array<{SET}>, title_sets array<{SET}>, neighbours array<struct<entity:string,title:string>>",
        ["edge_items", "chunk_items"],
    )
    listed = lambda names, norms, sets: F.transform(
        names, lambda label, i: F.struct(i.alias("pos"), label.alias("label"), F.get(norms, i).alias("norm"), F.coalesce(F.get(sets, i), no_set()).alias("set"))
    )
    item = f"struct<pos:int,label:string,norm:string,set:{SET}>"
    answer = F.struct(
        F.col("answer").alias("text"), F.col("answer_norm").alias("norm"), F.coalesce(F.element_at("entity_sets", -1), no_set()).alias("set"),
        F.coalesce("grounded", F.lit(False)).alias("grounded"),
    )
    return made.select(
        "graph_id", "hop_type", answer.alias("end"), F.coalesce(listed("question_entities", F.col("asked"), F.col("entity_sets")), empty(item)).alias("entities"),
        F.coalesce(listed("titles", F.col("title_norms"), F.col("title_sets")), empty(item)).alias("titles"), "neighbours", "size",
    )


def found_path(edges: list[list], at: dict[str, list[int]], src: str, dst: str) -> list[str]:
    """The path of components.path_nodes from src to dst, empty for none. at: the edges of each node."""
    if src not in at or dst not in at:
        return []
    hops, line = {src: 0}, [src]
    while line and dst not in hops:
        line = [n for a in line for k in at[a] for n in edges[k] if n is not None and n not in hops and not hops.update({n: hops[a] + 1})]
    if dst not in hops:
        return []
    path = [dst]
    while path[-1] != src:
        path.append(min(n for k in at[path[-1]] for n in edges[k] if n is not None and hops.get(n) == hops[path[-1]] - 1))
    return path[::-1]


def edges_at(edges: list[list]) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for k, names in enumerate(edges):
        for n in dict.fromkeys(names):
            if n is not None:
                at.setdefault(n, []).append(k)
    return at


def path_edges(edges: DataFrame, ends: DataFrame, most: int = ROW_PLACES) -> DataFrame:
    """(graph_id, size, hops): for (graph_id, src, dst) rows the hops of components.path_edges, with the edge_seq of each edge.

    Graphs of more than `most` places have none.
    """
    order = [(~F.col("is_gold")).alias("plain"), (-F.size("entities")).alias("few"), "edge_seq", "edge_id", "entities"]  # as projection.best_edge
    own = gathered(edges.select("graph_id", "is_gold", "edge_seq", "edge_id", "entities"), F.struct(*order), F.size("entities"), most)
    asked = ends.groupBy("graph_id").agg(F.collect_set(F.struct("src", "dst")).alias("ends"))
    rows = own.join(asked, "graph_id").withColumn("items", F.array_sort("items"))
    kinds = {n: edges.schema[n].dataType.simpleString() for n in ("edge_seq", "edge_id")}

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column, out, first = batch.column("items"), [], 0
        flat = column.flatten()
        seq, name = flat.field(2), flat.field(3)
        for (items,), (srcs, dsts) in zip(lists(column, 4), lists(batch.column("ends"), 0, 1), strict=True):
            at, hops = edges_at(items), []
            for src, dst in zip(srcs, dsts, strict=True):
                path = found_path(items, at, src, dst)
                for pos, (a, b) in enumerate(zip(path, path[1:], strict=False), 1):
                    k = next(k for k in at[a] if b in items[k])
                    hops.append({"src": src, "dst": dst, "pos": pos, "from_node": a, "to_node": b, "edge_id": name[first + k].as_py(), "edge_seq": seq[first + k].as_py()})
            out.append(hops)
            first += len(items)
        hop = [(n, pa.string()) for n in ("src", "dst")] + [("pos", pa.int32())] + [(n, pa.string()) for n in ("from_node", "to_node", "edge_id")] + [("edge_seq", seq.type)]
        return {"hops": pa.array(out, pa.list_(pa.struct(hop)))}

    added = f"hops array<struct<src:string,dst:string,pos:int,from_node:string,to_node:string,edge_id:{kinds['edge_id']},edge_seq:{kinds['edge_seq']}>>"
    return in_rows(rows, work, added, ["items", "ends"])


def _reads(edges: list[list], edge_chunks: list, chunk_ids: list, chunk_titles: list, chunk_order: list, targets: list[tuple[list, str | None]], most: int) -> list[dict]:
    """For each target (norms of its sources, norm of its end): which source resolves first, and the places of up to `most` chunks that mention an end."""
    at = edges_at(edges)
    names = Names(edges, edge_chunks, chunk_ids, chunk_titles, [n for own, end in targets for n in (*own, end)], at)
    order = sorted(range(len(chunk_ids)), key=chunk_order.__getitem__)
    known: dict = {}

    def nodes(norm: str | None) -> list:
        if norm not in known:
            known[norm] = names.as_entity(norm) or names.as_title(norm)
        return known[norm]

    out = []
    for own, end in targets:
        src = next((k for k, n in enumerate(own) if nodes(n)), None)
        met = set() if src is None else {edge_chunks[k] for n in (*nodes(own[src]), *nodes(end)) for k in at.get(n, ())} - {None}
        out.append({"source": src, "read": [k for k in order if chunk_ids[k] in met][:most] if met else []})
    return out


def reads(targets: DataFrame, edges: DataFrame, chunks: DataFrame, most_chunks: int, most: int = ROW_PLACES) -> DataFrame:
    """(graph_id, size, targets): the targets of repair.repair_targets with src and dst of repair.endpoints and, as an array, the chunks of repair.source_chunks.

    Those of graphs of more than `most` places aren't looked up.
    """
    ids = targets.select("graph_id").distinct()
    kept = lambda rows: rows.join(ids, "graph_id", "left_semi")
    by_edge = gathered(kept(edges.select("graph_id", "chunk_id", "entities")), F.struct("chunk_id", "entities"), F.size("entities"), most)
    chunk = F.struct("chunk_id", normalize(F.col("title")).alias("title"), "chunk_idx", "sentences", "gold_sentence_offsets")
    by_chunk = gathered(kept(chunks), chunk, F.lit(1), most)
    src_norms, dst = F.transform("src_options", normalize).alias("src_norms"), F.get("dst_options", 0)
    item = F.struct("target_pos", "kind", "src_options", "dst_options", src_norms, normalize(dst).alias("dst_norm"))
    rows = targets.groupBy("graph_id").agg(F.collect_list(item).alias("targets"))
    rows = rows.join(by_edge.withColumnsRenamed({"items": "edge_items", "size": "places"}), "graph_id", "left")
    rows = rows.join(by_chunk.withColumnRenamed("items", "chunk_items"), "graph_id", "left")
    rows = rows.withColumn("size", F.coalesce(F.greatest("places", "size"), F.lit(0).cast("long"))).drop("places")

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        columns = zip(lists(batch.column("edge_items"), 0, 1), lists(batch.column("chunk_items"), 0, 1, 2), lists(batch.column("targets"), 4, 5), strict=True)
        found = [_reads(entities, at, ids, titles, order, list(zip(*asked, strict=True)), most_chunks) for (at, entities), (ids, titles, order), asked in columns]
        return {"found": pa.array(found, pa.list_(pa.struct([("source", pa.int32()), ("read", pa.list_(pa.int32()))])))}

    made = in_rows(rows, work, "found array<struct<source:int,read:array<int>>>", ["edge_items"])
    looked_up = lambda t, f: F.struct(
        t["target_pos"].alias("target_pos"), t["kind"].alias("kind"), t["src_options"].alias("src_options"), t["dst_options"].alias("dst_options"),
        F.get(t["src_options"], f["source"]).alias("src"), F.get(t["dst_options"], F.lit(0)).alias("dst"),
        F.transform(f["read"], lambda k: F.get("chunk_items", k)).alias("read"),
    )
    return made.select("graph_id", "size", F.zip_with("targets", "found", looked_up).alias("targets"))


def _scores(questions: list, sentences: list[list], encoder) -> list[float]:
    """The vectors.cosine of each question with its own sentences, one after the other."""
    pairs = [(g, text or "") for g, own in enumerate(sentences) for text in own]
    out: list[float] = []
    for at in range(0, len(pairs), SCORED):
        own = pairs[at : at + SCORED]
        asked = {g: k for k, g in enumerate(dict.fromkeys(g for g, _ in own))}
        q, v = (np.asarray(encoder(texts), np.float32).astype(np.float64) for texts in ([questions[g] or "" for g in asked], [text for _, text in own]))
        # summed from first to last, as the column does, so that equal scores stay equal
        out += (np.cumsum(q[[asked[g] for g, _ in own]] * v, axis=1)[:, -1] + 0.0).tolist()
    return out


def met_edges(questions: DataFrame, edges: DataFrame, starts: DataFrame, hops: int, most: int = ROW_PLACES, encoder=hashing_encoder) -> DataFrame:
    """(graph_id, size, met): the edges met while walking `hops` rounds from (graph_id, entity_id) starts, as an array with the round of each and its score of retrieve.scored_edges.

    Graphs of more than `most` places have none. No vector leaves its task.
    """
    names = ["edge_id", "edge_seq", "sentence", "entities"]
    own = gathered(edges.select("graph_id", *names), F.struct(*names), F.size("entities"), most)
    # the estimate of a stored table's size knows its compressed bytes alone, so that sides of any number of rows would be broadcast
    asked = starts.groupBy("graph_id").agg(F.collect_set("entity_id").alias("starts")).join(questions.select("graph_id", "question").hint("merge"), "graph_id")
    rows = own.join(asked.hint("merge"), "graph_id")
    kinds = {n: edges.schema[n].dataType.simpleString() for n in names}

    def walk(entities: list[list], front: list[str]) -> dict[int, int]:
        at, seen, met = edges_at(entities), set(front), {}
        for hop in range(1, hops + 1):
            new = {k for n in front for k in at.get(n, ()) if k not in met}
            met.update(dict.fromkeys(sorted(new), hop))
            front = {n for k in new for n in entities[k] if n is not None} - seen
            seen |= front
        return met

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column, places, rounds, ends, first = batch.column("items"), [], [], [0], 0
        for (entities,), front in zip(lists(column, 3), batch.column("starts").to_pylist(), strict=True):
            met = walk(entities, front)
            places += [first + k for k in met]
            rounds += met.values()
            ends.append(len(places))
            first += len(entities)
        taken = column.flatten().take(pa.array(places, pa.int64()))
        said = taken.field(2).to_pylist()
        scores = _scores(batch.column("question").to_pylist(), [said[a:b] for a, b in itertools.pairwise(ends)], encoder)
        columns = [*(taken.field(k) for k in range(len(names))), pa.array(rounds, pa.int32()), pa.array(scores, pa.float64())]
        return {"met": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [*names, "hop", "score"]))}

    item = ",".join(f"{n}:{kinds[n]}" for n in names)
    return in_rows(rows, work, f"met array<struct<{item},hop:int,score:double>>", ["items", "starts", "question"])
