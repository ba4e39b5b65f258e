"""Whether the reasoning chain from question to answer is connected, for all samples in one plan.

A set of nodes is kept as {entities, parts}: parts lists, for each component it
reaches, its least and greatest node there. Two sets hold two different
connected nodes exactly if they share a component in which they aren't one and
the same single node. So verdicts need components, and no paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PREDICATE_ANSWERS, grounded, normalize

#: Failure modes, worst first.
SEVERITY = (
    "no_question_entities", "src_unresolved", "broken_mid_chain", "predicate_broken", "broken_terminal",
    "answer_not_entity", "healed", "predicate_ok", "connected",
)
REPAIRABLE = ("broken_mid_chain", "broken_terminal", "predicate_broken")
SET = "struct<entities:array<string>,parts:array<struct<component:string,lo:string,hi:string>>>"
SEGMENT = "struct<from_node:string,to_node:string,is_broken:boolean,is_fallback:boolean>"
TERMINAL = "struct<status:string,answer:string,answer_entities:array<string>,text_grounded:boolean,is_trivial:boolean>"


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def no_set() -> Column:
    return F.struct(empty("string").alias("entities"), empty("struct<component:string,lo:string,hi:string>").alias("parts"))


def node_sets(resolved: DataFrame, parts: DataFrame) -> DataFrame:
    """(graph_id, norm, set) of (graph_id, norm, entity_id) rows; parts: (graph_id, node, component)."""
    named = parts.select("graph_id", F.col("node").alias("entity_id"), "component")
    per_part = resolved.select("graph_id", "norm", "entity_id").distinct().join(named, ["graph_id", "entity_id"], "left")
    per_part = per_part.groupBy("graph_id", "norm", "component").agg(
        F.collect_list("entity_id").alias("own"), F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi")
    )
    within = F.when(F.col("component").isNotNull(), F.struct(F.col("component").cast("string").alias("component"), "lo", "hi"))
    return per_part.groupBy("graph_id", "norm").agg(
        F.struct(F.array_sort(F.flatten(F.collect_list("own"))).alias("entities"), F.array_sort(F.collect_list(within)).alias("parts")).alias("set")
    )


def connected(a: Column, b: Column) -> Column:
    """Whether some node of a reaches a different node of b."""
    one_node = lambda x, y: (x["lo"] == x["hi"]) & (y["lo"] == y["hi"]) & (x["lo"] == y["lo"])
    return F.exists(a["parts"], lambda x: F.exists(b["parts"], lambda y: (x["component"] == y["component"]) & ~one_node(x, y)))


def _segment(start: Column, end: Column, broken: bool, fallback: bool) -> Column:
    return F.struct(
        start.alias("from_node"), end.alias("to_node"), F.lit(broken).alias("is_broken"), F.lit(fallback).alias("is_fallback")
    )


def segments(waypoints: Column) -> Column:
    """Segments along an array of (label, set) waypoints.

    A break before the last hop may be healed by going on to the waypoint after
    the next; then the break and the way around it are both recorded.
    """
    n = F.size(waypoints)
    at = lambda i: F.get(waypoints, i)
    start = F.struct(F.lit(0).alias("next"), empty(SEGMENT).alias("out"))

    def step(state: Column, i: Column) -> Column:
        here, there, beyond = at(i), at(i + 1), at(i + 2)
        near = connected(here["set"], there["set"])
        far = (i + 2 < n) & F.coalesce(connected(here["set"], beyond["set"]), F.lit(False))
        gap = _segment(here["label"], there["label"], True, False)
        added = (
            F.when(near, F.array(_segment(here["label"], there["label"], False, False)))
            .when(far, F.array(gap, _segment(here["label"], beyond["label"], False, True)))
            .otherwise(F.array(gap))
        )
        moved = F.struct((i + F.when(~near & far, 2).otherwise(1)).alias("next"), F.concat(state["out"], added).alias("out"))
        return F.when(i < state["next"], state).otherwise(moved)

    walk = F.aggregate(F.sequence(F.lit(0), n - 2), start, step, lambda s: s["out"])
    return F.when(n > 1, walk).otherwise(empty(SEGMENT))


def last_set(waypoints: Column, chain: Column) -> Column:
    """Where the chain stands before the answer: the last waypoint if its segment holds, else nothing."""
    end = F.element_at(waypoints, -1)["set"]
    reached = F.coalesce(~F.get(chain, F.size(chain) - 1)["is_broken"], F.lit(False))
    return F.when((F.size(waypoints) == 1) | reached, end).otherwise(no_set())


def terminal(stand: Column, answer: Column, titles: Column) -> Column:
    """Verdict on the hop to the answer.

    answer: struct(text, norm, set, grounded); titles: normalised titles that
    make the answer trivial when it equals one.
    """
    own = answer["set"]
    is_title = F.array_contains(titles, answer["norm"])
    overlap = F.arrays_overlap(own["entities"], stand["entities"])
    predicate = answer["norm"].isin(*PREDICATE_ANSWERS)
    missing, lost = F.size(own["entities"]) == 0, F.size(stand["entities"]) == 0
    reached = is_title | overlap | connected(stand, own)
    status = (
        F.when(predicate, "predicate").when(missing, "not_an_entity").when(lost, "entity_unreached").when(reached, "entity_reached").otherwise("entity_unreached")
    )
    return F.struct(
        status.alias("status"),
        answer["text"].alias("answer"),
        F.when(predicate, empty("string")).otherwise(own["entities"]).alias("answer_entities"),
        answer["grounded"].alias("text_grounded"),
        F.when(predicate | missing, False).otherwise(F.coalesce(is_title | overlap, F.lit(False))).alias("is_trivial"),
    )


def heals(chain: Column) -> Column:
    return F.size(F.filter(chain, lambda s: s["is_fallback"] & ~s["is_broken"]))


def breaks(chain: Column) -> Column:
    return F.size(F.filter(chain, lambda s: s["is_broken"]))


def unhealed_breaks(chain: Column) -> Column:
    """Breaks that were gone around, or infinity if one wasn't."""
    return F.when(breaks(chain) == heals(chain), heals(chain).cast("double")).otherwise(F.lit(float("inf")))


def is_connected(chain: Column) -> Column:
    return breaks(chain) == heals(chain)


def chain_rank(chain: Column, end: Column) -> Column:
    """Order of candidate chains: fewest breaks, then a reached terminal, then one that isn't trivial."""
    return F.struct(
        unhealed_breaks(chain).alias("breaks"), (end["status"] == "entity_unreached").cast("int").alias("unreached"), end["is_trivial"].cast("int").alias("trivial")
    )


def chain_mode(chain: Column, end: Column) -> Column:
    """Failure mode of one chain."""
    status = end["status"]
    return (
        F.when(~is_connected(chain), F.when(status == "predicate", "predicate_broken").otherwise("broken_mid_chain"))
        .when(status == "entity_unreached", "broken_terminal")
        .when(status == "not_an_entity", "answer_not_entity")
        .when(status == "predicate", "predicate_ok")
        .when(heals(chain) > 0, "healed")
        .otherwise("connected")
    )


def severity(mode: Column) -> Column:
    return F.array_position(F.array(*(F.lit(m) for m in SEVERITY)), mode) - 1


def worst_mode(modes: Column) -> Column:
    """The worst mode in an array; broken_mid_chain for none."""
    rank = F.array_min(F.transform(modes, severity))
    return F.coalesce(F.get(F.array(*(F.lit(m) for m in SEVERITY)), rank.cast("int")), F.lit("broken_mid_chain"))


def paired(entities: Column, titles: Column, neighbours: Column) -> Column:
    """For each entity the title it is paired with: an array of (entity, title), title null where none is left.

    entities: structs with norm; titles: structs with pos and norm; neighbours:
    (entity, title) pairs of norms that share a graph neighbour. An entity takes
    the first title left that equals it, else that holds it or is held by it,
    else that is a neighbour.
    """
    holds = lambda e, t: F.contains(t["norm"], e["norm"]) | F.contains(e["norm"], t["norm"])
    near = lambda e, t: F.exists(neighbours, lambda x: (x["entity"] == e["norm"]) & (x["title"] == t["norm"]))

    def step(state: Column, e: Column) -> Column:
        first = lambda fits: F.get(F.filter(state["left"], fits), 0)
        got = F.coalesce(first(lambda t: t["norm"] == e["norm"]), first(lambda t: holds(e, t)), first(lambda t: near(e, t)))
        left = F.filter(state["left"], lambda t: got.isNull() | (t["pos"] != got["pos"]))
        return F.struct(left.alias("left"), F.concat(state["out"], F.array(F.struct(e.alias("entity"), got.alias("title")))).alias("out"))

    none = F.slice(F.transform(entities, lambda e: F.struct(e.alias("entity"), F.get(titles, -1).alias("title"))), 1, 0)
    return F.aggregate(entities, F.struct(titles.alias("left"), none.alias("out")), step, lambda s: s["out"])


def shared_neighbours(entities: DataFrame, neighbour_rows: DataFrame, title_nodes: DataFrame) -> DataFrame:
    """(graph_id, neighbours): pairs of an entity's and a title's norm where a neighbour of the one belongs to the other."""
    a = entities.select("graph_id", F.col("norm").alias("entity")).distinct()
    near = a.join(neighbour_rows.select("graph_id", F.col("entity_id").alias("entity"), F.col("neighbor").alias("node")), ["graph_id", "entity"])
    met = near.join(title_nodes.select("graph_id", F.col("norm").alias("title"), F.col("entity_id").alias("node")), ["graph_id", "node"])
    return met.groupBy("graph_id").agg(F.collect_set(F.struct("entity", "title")).alias("neighbours"))


def prepared(samples: DataFrame, chunks: DataFrame, entity_hits: DataFrame, title_hits: DataFrame, parts: DataFrame, neighbour_rows: DataFrame) -> DataFrame:
    """One row a sample with all that the audit looks at.

    samples: (graph_id, answer, hop_type, gold, question_entities, parse_failures);
    gold: array of (pos, title, ..). entity_hits and title_hits: (graph_id, norm,
    entity_id) of question entities, answers and titles. neighbour_rows:
    (graph_id, entity_id, neighbor) of the projected graph.
    """
    by_entity, by_title = node_sets(entity_hits, parts), node_sets(title_hits, parts)

    def listed(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        own = rows.withColumn("norm", normalize(F.col("label"))).join(sets, ["graph_id", "norm"], "left")
        own = own.withColumn("set", F.coalesce("set", no_set()))
        return own.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "norm", "set"))).alias(name))

    asked = samples.select("graph_id", F.posexplode("question_entities").alias("pos", "label"))
    gold = samples.select("graph_id", F.posexplode(F.transform(F.array_sort("gold"), lambda g: g["title"])).alias("pos", "label"))
    found = chunks.select("graph_id", "sentences").join(samples.select("graph_id", "answer"), "graph_id")
    found = found.groupBy("graph_id").agg(F.bool_or(grounded(F.col("answer"), F.col("sentences"))).alias("grounded"))
    near = shared_neighbours(asked.withColumn("norm", normalize(F.col("label"))), neighbour_rows, title_hits)
    out = samples.withColumn("norm", normalize(F.col("answer"))).join(by_entity, ["graph_id", "norm"], "left").join(found, "graph_id", "left")
    answer = F.struct(
        F.col("answer").alias("text"), "norm", F.coalesce("set", no_set()).alias("set"), F.coalesce("grounded", F.lit(False)).alias("grounded")
    )
    out = out.withColumn("end", answer).drop("norm", "set", "grounded")
    item = f"struct<pos:int,label:string,norm:string,set:{SET}>"
    out = out.join(listed(asked, by_entity, "entities"), "graph_id", "left").join(listed(gold, by_title, "titles"), "graph_id", "left").join(near, "graph_id", "left")
    return out.withColumns({
        "entities": F.coalesce("entities", empty(item)), "titles": F.coalesce("titles", empty(item)),
        "neighbours": F.coalesce("neighbours", empty("struct<entity:string,title:string>")),
    })


def _waypoints(entity: Column, titles: Column) -> Column:
    """The source, as itself where it resolves to nothing, then the titles."""
    itself = F.struct(F.array(entity["norm"]).alias("entities"), empty("struct<component:string,lo:string,hi:string>").alias("parts"))
    own = F.when(F.size(entity["set"]["entities"]) > 0, entity["set"]).otherwise(itself)
    first = F.struct(F.lit("src").alias("label"), own.alias("set"))
    return F.concat(F.array(first), F.transform(titles, lambda t: F.struct(t["label"].alias("label"), t["set"].alias("set"))))


def audit_chains(ready: DataFrame) -> DataFrame:
    """(graph_id, chain_pos, segments, terminal) of every sample; terminal is null on audit rows."""
    names = F.transform("titles", lambda t: t["norm"])
    no_entities = F.size("entities") == 0
    none_found = ~F.exists("entities", lambda e: F.size(e["set"]["entities"]) > 0)
    lost = no_entities | none_found
    sound = ready.filter(~lost)
    gap = lambda a, b: F.array(_segment(a, b, True, False))
    nowhere = terminal(no_set(), F.col("end"), names)

    early = ready.filter(lost | ((F.col("hop_type") == "comparison") & (F.size("titles") == 0)))
    early = early.select("graph_id", F.lit(0).alias("chain_pos"), gap(F.lit("src"), F.lit("dst")).alias("segments"), nowhere.alias("terminal"))

    bridge = sound.filter("hop_type = 'bridge'").select("graph_id", "end", "titles", F.explode("entities").alias("e"))
    bridge = bridge.withColumn("waypoints", _waypoints(F.col("e"), F.col("titles"))).withColumn("segments", segments(F.col("waypoints")))
    bridge = bridge.withColumn("terminal", terminal(last_set(F.col("waypoints"), F.col("segments")), F.col("end"), names))
    order = F.struct(chain_rank(F.col("segments"), F.col("terminal")), F.col("e.pos"))
    bridge = bridge.groupBy("graph_id").agg(F.min_by(F.struct("segments", "terminal"), order).alias("c"))
    bridge = bridge.select("graph_id", F.lit(0).alias("chain_pos"), "c.segments", "c.terminal")

    pairs = paired(F.col("entities"), F.col("titles"), F.col("neighbours"))
    both = sound.filter("hop_type = 'comparison' and size(titles) > 0").withColumn("pairs", pairs)
    each = both.select("graph_id", "end", "titles", "pairs", F.explode("titles").alias("t"))
    each = each.withColumn("e", F.get(F.filter("pairs", lambda p: p["title"]["pos"] == F.col("t.pos")), 0)["entity"])
    each = each.withColumn("waypoints", _waypoints(F.col("e"), F.array("t"))).withColumn("own", segments(F.col("waypoints")))
    has = F.col("e").isNotNull()
    each = each.select(
        "graph_id",
        F.col("t.pos").alias("chain_pos"),
        F.when(has, F.col("own")).otherwise(gap(F.lit("???"), F.col("t.label"))).alias("segments"),
        F.when(has, terminal(last_set(F.col("waypoints"), F.col("own")), F.col("end"), F.array("t.norm"))).otherwise(nowhere).alias("terminal"),
    )
    alone = both.select("graph_id", F.size("titles").alias("n"), F.posexplode(F.filter("pairs", lambda p: p["title"].isNull())).alias("k", "p"))
    alone = alone.select(
        "graph_id", (F.col("n") + F.col("k")).alias("chain_pos"), gap(F.col("p.entity.label"), F.lit("???")).alias("segments"), F.lit(None).cast(TERMINAL).alias("terminal")
    )
    return early.unionByName(bridge).unionByName(each).unionByName(alone)


def reports(samples: DataFrame, ready: DataFrame, chains: DataFrame) -> DataFrame:
    """One row a sample: the verdict and its summary columns."""
    real = F.col("terminal").isNotNull()
    line, end = F.col("segments"), F.col("terminal")
    good = is_connected(line) & (end["status"] != "entity_unreached")
    detail = F.struct(
        end["status"].alias("status"), end["is_trivial"].alias("is_trivial"),
        ((end["status"] == "entity_reached") & ~end["is_trivial"]).alias("is_genuine"), is_connected(line).alias("is_connected"),
    )
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.when(real, F.struct("chain_pos", value.alias("v"))))), lambda x: x["v"])
    per = chains.groupBy("graph_id").agg(
        F.coalesce(F.bool_and(F.when(real, good)), F.lit(False)).alias("is_answerable"),
        F.coalesce(F.bool_and(F.when(real, is_connected(line) & (heals(line) == 0))), F.lit(True)).alias("all_clean"),
        ordered(end["status"]).alias("terminal"),
        ordered(detail).alias("chain_terminals"),
        F.coalesce(F.bool_or(end["is_trivial"]), F.lit(False)).alias("trivial_terminal"),
        F.coalesce(F.bool_or((end["status"] == "entity_reached") & ~end["is_trivial"]), F.lit(False)).alias("genuine_terminal"),
        F.coalesce(F.bool_or(end["text_grounded"]), F.lit(False)).alias("text_grounded"),
        F.count("*").alias("num_reasoning_chains"),
        F.sum(breaks(line)).alias("total_broken_hops"),
        F.sum(F.when(is_connected(line), heals(line)).otherwise(0)).alias("num_heals"),
        F.min(F.when(real, severity(chain_mode(line, end)))).alias("worst"),
    )
    own = ready.select(
        "graph_id",
        F.when(F.size("entities") == 0, 0).when(~F.exists("entities", lambda e: F.size(e["set"]["entities"]) > 0), 1).alias("early"),
    )
    rank = F.coalesce(F.col("early"), F.col("worst").cast("int"), F.lit(SEVERITY.index("broken_mid_chain")))
    mode = F.get(F.array(*(F.lit(m) for m in SEVERITY)), rank)
    joined = samples.join(own, "graph_id").join(per, "graph_id", "left").withColumn("failure_mode", mode)
    zero = F.lit(0).cast("long")
    false = F.lit(False)
    return joined.select(
        F.col("graph_id").alias("sample_id"), "hop_type", "failure_mode", F.coalesce("is_answerable", false).alias("is_answerable"),
        F.coalesce(F.col("is_answerable") & F.col("all_clean"), false).alias("is_clean"), F.col("failure_mode").isin(*REPAIRABLE).alias("is_repairable"),
        "question_entities", "answer", F.coalesce("terminal", empty("string")).alias("terminal"),
        F.coalesce("chain_terminals", empty("struct<status:string,is_trivial:boolean,is_genuine:boolean,is_connected:boolean>")).alias("chain_terminals"),
        F.coalesce("trivial_terminal", false).alias("trivial_terminal"), F.coalesce("genuine_terminal", false).alias("genuine_terminal"),
        F.coalesce("text_grounded", false).alias("text_grounded"), F.coalesce("num_reasoning_chains", zero).alias("num_reasoning_chains"),
        F.coalesce("total_broken_hops", zero).alias("total_broken_hops"), F.coalesce("num_heals", zero).alias("num_heals"), "parse_failures",
        F.transform(F.array_sort("gold"), lambda g: g["title"]).alias("supporting_titles"),
    )


def first_per_graph(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each graph."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
