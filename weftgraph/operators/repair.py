"""Repair of broken chains by asking again for the facts that would close a gap.

All gaps are worked on at once against the graph as it was before; facts of one
batch don't see each other's nodes, only each other's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

MAX_CHUNKS, MAX_EDGES = 3, 4


def repair_targets(samples: DataFrame, chains: DataFrame) -> DataFrame:
    """(graph_id, target_pos, kind, src_options, dst_options) from what is broken.

    A broken segment asks for a link between its ends, the source standing for
    all question entities; a broken terminal for one from the last gold title to
    the answer. Targets that repeat, and those from a name to itself, go. Audit
    rows have none.
    """
    real = chains.filter("terminal is not null").join(
        samples.select("graph_id", "answer", "question_entities", F.transform(F.array_sort("gold"), lambda g: g["title"]).alias("titles")), "graph_id"
    )
    options = lambda name: F.when(name == "src", F.col("question_entities")).otherwise(F.array(name))
    gaps = real.select("graph_id", "chain_pos", "question_entities", F.posexplode("segments").alias("k", "s")).filter("s.is_broken")
    gaps = gaps.select("graph_id", "chain_pos", "k", F.lit("segment").alias("kind"), options(F.col("s.from_node")).alias("src_options"), options(F.col("s.to_node")).alias("dst_options"))
    ends = real.filter("terminal.status = 'entity_unreached' and size(titles) > 0").select(
        "graph_id", "chain_pos", F.lit(1_000_000).alias("k"), F.lit("terminal").alias("kind"),
        F.array(F.get("titles", F.size("titles") - 1)).alias("src_options"), F.array("answer").alias("dst_options"),
    )
    once = gaps.unionByName(ends).groupBy("graph_id", "kind", "src_options", "dst_options").agg(F.min(F.struct("chain_pos", "k")).alias("first"))
    itself = (F.size("src_options") == 1) & (F.size("dst_options") == 1) & (normalize(F.get("src_options", 0)) == normalize(F.get("dst_options", 0)))
    order = Window.partitionBy("graph_id").orderBy("first")
    return once.filter(~itself).withColumn("target_pos", F.row_number().over(order) - 1).select("graph_id", "target_pos", "kind", "src_options", "dst_options")


def primary_gaps(samples: DataFrame, chains: DataFrame) -> DataFrame:
    """As `repair_targets`, in the plain form: one name on each side, the first question entity for the source, repeats kept."""
    real = chains.filter("terminal is not null").join(
        samples.select("graph_id", "answer", "question_entities", F.transform(F.array_sort("gold"), lambda g: g["title"]).alias("titles")), "graph_id"
    )
    name = lambda n: F.when(n == "src", F.get("question_entities", 0)).otherwise(n)
    gaps = real.select("graph_id", "chain_pos", "question_entities", F.posexplode("segments").alias("k", "s")).filter("s.is_broken")
    gaps = gaps.select("graph_id", "chain_pos", "k", F.lit("segment").alias("kind"), name(F.col("s.from_node")).alias("src"), name(F.col("s.to_node")).alias("dst"))
    ends = real.filter("terminal.status = 'entity_unreached' and size(titles) > 0").select(
        "graph_id", "chain_pos", F.lit(1_000_000).alias("k"), F.lit("terminal").alias("kind"), F.get("titles", F.size("titles") - 1).alias("src"), F.col("answer").alias("dst")
    )
    order = Window.partitionBy("graph_id").orderBy("chain_pos", "k")
    both = gaps.unionByName(ends).filter("src is not null and dst is not null")
    return both.withColumn("target_pos", F.row_number().over(order) - 1).select(
        "graph_id", "target_pos", "kind", F.array("src").alias("src_options"), F.array("dst").alias("dst_options")
    )


def endpoints(targets: DataFrame, names: DataFrame) -> DataFrame:
    """Targets with src (the first option that resolves, else null) and dst (the first option). names: (graph_id, norm, entity_id)."""
    known = names.select("graph_id", "norm").distinct().withColumn("known", F.lit(True))
    each = targets.select("graph_id", "target_pos", F.posexplode("src_options").alias("k", "name")).withColumn("norm", normalize(F.col("name")))
    first = each.join(known, ["graph_id", "norm"]).groupBy("graph_id", "target_pos").agg(F.min_by("name", "k").alias("src"))
    return targets.join(first, ["graph_id", "target_pos"], "left").withColumn("dst", F.get("dst_options", 0))


def source_chunks(
    ends: DataFrame, names: DataFrame, places: DataFrame, chunks: DataFrame, most: int = MAX_CHUNKS, both_sides: bool = True, lexical: bool = False
) -> DataFrame:
    """(graph_id, target_pos, chunk_idx, chunk_id, sentences): up to `most` chunks that mention an end.

    In sample order, or with `lexical` by chunk id as text. Without `both_sides`
    only chunks of the source count.
    """
    sides = [F.col("src"), F.col("dst")] if both_sides else [F.col("src")]
    named = ends.filter("src is not null").select("graph_id", "target_pos", F.explode(F.array(*sides)).alias("name"))
    nodes = named.withColumn("norm", normalize(F.col("name"))).join(names.select("graph_id", "norm", "entity_id"), ["graph_id", "norm"])
    met = nodes.join(places.select("graph_id", "entity_id", "chunk_id").distinct(), ["graph_id", "entity_id"]).select("graph_id", "target_pos", "chunk_id").distinct()
    own = met.join(chunks.select("graph_id", "chunk_id", "chunk_idx", "sentences", "gold_sentence_offsets"), ["graph_id", "chunk_id"])
    order = Window.partitionBy("graph_id", "target_pos").orderBy("chunk_id" if lexical else "chunk_idx")
    return own.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def new_edges(found: DataFrame, before: DataFrame, most_per_graph: int | None = None) -> DataFrame:
    """Edges of `found` that `before` doesn't have, repeats taken once, and at most so many of a graph.

    Both have graph_id, chunk_id, relation, entities; found also edge_seq for the order.
    """
    keyed = lambda df: df.withColumn("key", F.array_sort("entities"))
    on = ["graph_id", "chunk_id", "relation", "key"]
    fresh = keyed(found).join(keyed(before).select(*on).distinct(), on, "left_anti")
    first = Window.partitionBy(*on).orderBy("edge_seq")
    fresh = fresh.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "key")
    if most_per_graph is None:
        return fresh
    order = Window.partitionBy("graph_id").orderBy("edge_seq")
    return fresh.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_per_graph).drop("n")


def attempts(ends: DataFrame, read: DataFrame, added: DataFrame) -> DataFrame:
    """(graph_id, target_pos, kind, src, dst, status, new_edges, chunks_read): what came of each target.

    read: rows of `source_chunks`; added: (graph_id, target_pos) of each new edge.
    """
    seen = read.groupBy("graph_id", "target_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks_read"))
    got = added.groupBy("graph_id", "target_pos").agg(F.count("*").alias("new_edges"))
    joined = ends.join(seen, ["graph_id", "target_pos"], "left").join(got, ["graph_id", "target_pos"], "left")
    joined = joined.withColumn("new_edges", F.coalesce("new_edges", F.lit(0)))
    status: Column = (
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "unresolvable_endpoint")
        .when(F.col("chunks_read").isNull(), "no_source_chunks").when(F.col("new_edges") > 0, "found_facts").otherwise("nothing_new")
    )
    return joined.select(
        "graph_id", "target_pos", "kind", "src", "dst", status.alias("status"), "new_edges", F.coalesce("chunks_read", F.array().cast("array<string>")).alias("chunks_read")
    )


def repair_actions(calls: DataFrame, names: DataFrame, places: DataFrame, chunks: DataFrame) -> DataFrame:
    """Agent calls (graph_id, target_pos, src, dst) checked and joined with the chunks to read, by chunk id as text.

    refusal is `missing_argument` for a blank end, `unresolvable_source` for one
    without nodes, null for a call that is carried out.
    """
    blank = (F.coalesce(normalize(F.col("src")), F.lit("")) == "") | (F.coalesce(normalize(F.col("dst")), F.lit("")) == "")
    known = names.select("graph_id", F.col("norm")).distinct().withColumn("known", F.lit(True))
    own = calls.withColumn("norm", normalize(F.col("src"))).join(known, ["graph_id", "norm"], "left").drop("norm")
    refusal = F.when(blank, "missing_argument").when(F.col("known").isNull(), "unresolvable_source")
    own = own.withColumn("refusal", refusal).drop("known")
    read = source_chunks(own.filter("refusal is null"), names, places, chunks, both_sides=False, lexical=True)
    seen = read.groupBy("graph_id", "target_pos").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks_read"))
    return own.join(seen, ["graph_id", "target_pos"], "left").withColumn("chunks_read", F.coalesce("chunks_read", F.array().cast("array<string>")))


#: Argument kinds of a tool's declaration and the Python types they take.
ARGUMENT_TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict}


class Tool:
    """What an agent can call: a name, a description, arguments by JSON schema, and a reward."""

    name, description = "tool", ""
    parameters: dict = {"type": "object", "properties": {}, "required": ["query"]}

    def declaration(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": self.parameters}}

    def simple_declaration(self) -> str:
        named = ", ".join(f"{k}: {v.get('type', 'any')}" for k, v in self.parameters.get("properties", {}).items())
        return f"{self.name}({named}): {self.description}"

    def validate(self, args: dict) -> tuple[bool, str]:
        for key in self.parameters.get("required", ()):
            if key not in args:
                return False, f"missing argument: {key}"
        for key, value in args.items():
            kind = self.parameters.get("properties", {}).get(key, {}).get("type")
            if kind in ARGUMENT_TYPES and not isinstance(value, ARGUMENT_TYPES[kind]):
                return False, f"argument {key} isn't of type {kind}"
        return True, ""

    def execute(self, args: dict) -> str:
        raise NotImplementedError

    def execute_batch(self, calls: list[dict]) -> list[str]:
        return [self.execute(args) for args in calls]

    def reward(self, args: dict, result: str) -> float:
        return 0.0


class GraphRepair(Tool):
    """Repair as an agent's action: `run` turns (src, dst) into the tables of a repair and gives its JSON."""

    name = "graph_repair"
    description = "Look again for facts that link src to dst in the passages that mention src."
    parameters = {
        "type": "object",
        "properties": {"src": {"type": "string"}, "dst": {"type": "string"}},
        "required": ["src", "dst"],
    }

    def __init__(self, run):
        self.run = run

    def validate(self, args: dict) -> tuple[bool, str]:
        sound, why = super().validate(args)
        if not sound:
            return sound, why
        blank = [k for k in ("src", "dst") if not args[k].strip()]
        return (False, f"blank argument: {blank[0]}") if blank else (True, "")

    def execute(self, args: dict) -> str:
        import json

        sound, why = self.validate(args)
        return json.dumps(self.run(args["src"], args["dst"]) if sound else {"error": why})
