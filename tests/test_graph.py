import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import components, hypergraph, projection, resolve

FACT = (
    "graph_id int, chunk_idx int, fact_pos int, chunk_id string, raw_entities array<string>, relation string, sentence_index int, confidence double, "
    "sentences array<string>, gold_sentence_offsets array<int>"
)


def fact(entities, pos=0, relation="likes", sentence=0, chunk=0, graph=1, gold=()):
    return (graph, chunk, pos, f"c{chunk}", entities, relation, sentence, 1.0, ["s0", "s1", "s2", "s3"], list(gold))


def edges_of(spark, *facts):
    return hypergraph.hyperedges(spark.createDataFrame(list(facts), FACT))


def test_first_of_equal_facts_stays(spark):
    got = edges_of(spark, fact(["A ", "b"], 0, sentence=0), fact(["b", "a"], 1, " LIKES ", sentence=3), fact(["a", "A"], 2)).collect()
    assert len(got) == 1 and got[0].sentence_index == 0 and got[0].entities == ["a", "b"] and got[0].sentence == "s0"


def test_repeats_in_an_edge_make_no_loop(spark):
    e = edges_of(spark, fact(["a", "b", "a"], 0), fact(["b", "a"], 1, gold=[0]))
    pairs = projection.pairs(e).collect()
    assert [(p.src, p.dst, p.is_gold, len(p.edge_ids)) for p in pairs] == [("a", "b", True, 2)]
    best = projection.best_edge(e).first().edge_id
    assert e.filter(F.col("edge_id") == best).first().is_gold
    stats = projection.graph_stats(e).first()
    assert (stats.nodes, stats.self_loops, stats.components, stats.density, stats.max_arity) == (2, 0, 1, 1.0, 2)
    assert projection.graph_stats(e, directed=True).first().components is None
    assert hypergraph.graph_summary(e).first().avg_arity == 2.5
    assert hypergraph.edges_for_entity(hypergraph.incidence(e), e).filter("entity_id = 'a'").count() == 2


def test_node_label_is_the_first_spelling(spark):
    n = hypergraph.nodes(hypergraph.incidence(edges_of(spark, fact(["Ada", "b"], 0), fact(["ADA", "c"], 1))))
    assert n.filter("entity_id = 'ada'").first().label == "Ada"


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_hops_against_search(spark, seed):
    rng = random.Random(seed)
    links = [(g, a, b) for g in (1, 2) for a, b in {tuple(sorted((f"n{rng.randrange(30)}", f"n{rng.randrange(30)}"))) for _ in range(22)} if a != b]
    pairs = spark.createDataFrame(links, "graph_id int, src string, dst string").repartition(3)
    near: dict = {}
    for g, a, b in links:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)

    def far(g, start):
        hops, line = {start: 0}, [start]
        for x in line:
            for y in near[g, x]:
                if y not in hops:
                    hops[y] = hops[x] + 1
                    line.append(y)
        return hops

    got = {(r.graph_id, r.node): r.component for r in components.components(pairs).collect()}
    assert got == {k: min(far(*k)) for k in near}
    sources = spark.createDataFrame([(1, links[0][1]), (2, "absent")], "graph_id int, source string")
    hops = {(r.graph_id, r.node): r.hops for r in components.hop_counts(pairs, sources).collect()}
    assert hops == {(1, k): v for k, v in far(1, links[0][1]).items()}
    asked = spark.createDataFrame([(1, a, b) for a, b in itertools.product(["n1", "n2", "zz"], ["n1", "n3"])], "graph_id int, src string, dst string")
    for r in components.shortest_paths(pairs, asked).collect():
        want = far(1, r.src).get(r.dst) if (1, r.src) in near else None
        assert r.found == (want is not None) and (not r.found or (len(r.path) == want + 1 and r.path[0] == r.src and r.path[-1] == r.dst))


def test_resolution_tiers(spark):
    nodes = spark.createDataFrame(
        [(1, n, n) for n in ("robert erskine childers", "roman empire", "roman catholic church", "nolan", "not")], "graph_id int, entity_id string, label string"
    )
    labels = spark.createDataFrame([(1, x) for x in ("Robert Erskine Childers DSC", "roman", "no", "NOLAN", " ")], "graph_id int, label string")
    got = {}
    for r in resolve.resolve_entities(labels, nodes).collect():
        got.setdefault(r.norm, set()).add((r.entity_id, r.tier))
    assert got == {
        "robert erskine childers dsc": {("robert erskine childers", 2)},
        "roman": {("roman empire", 2), ("roman catholic church", 2)},
        "nolan": {("nolan", 1)},
    }
    near = resolve.resolve_entities(spark.createDataFrame([(1, "romans empires")], "graph_id int, label string"), nodes, semantic=True, least=0.2)
    assert [(r.entity_id, r.tier) for r in near.orderBy("entity_id").collect()][0][1] == 3


def test_title_tiers_one_and_name_are_united(spark):
    nodes = spark.createDataFrame([(1, n, n) for n in ("p", "q", "t")], "graph_id int, entity_id string, label string")
    own = spark.createDataFrame([(1, "t", "p"), (1, "t", "q")], "graph_id int, title string, entity_id string")
    got = resolve.resolve_titles(spark.createDataFrame([(1, "T")], "graph_id int, title string"), nodes, own)
    assert {r.entity_id for r in got.collect()} == {"p", "q", "t"}


def test_snapping(spark):
    new = spark.createDataFrame([(1, "f", i, x) for i, x in enumerate(["Known", "nearly", "many", "None Such"])], "graph_id int, fact_id string, pos int, label string")
    known = spark.createDataFrame([(1, "known")], "graph_id int, entity_id string")
    hits = spark.createDataFrame([(1, "nearly", "known"), (1, "many", "x"), (1, "many", "y")], "graph_id int, label string, entity_id string")
    got = {r.label: (r.entity, r.snapped) for r in hypergraph.snapped(new, known, hits).collect()}
    assert got == {"Known": ("known", False), "nearly": ("known", True), "many": ("many", False), "None Such": ("none such", False)}


def test_paths_and_best_ends_against_search(spark):
    import random
    from collections import deque

    from weftgraph.operators import components

    rng = random.Random(12)
    links = {(g, *sorted(rng.sample(range(14), 2))) for g in range(6) for _ in range(13)}
    rows = [(g, f"n{a:02}", f"n{b:02}") for g, a, b in sorted(links)]
    pairs = spark.createDataFrame(rows, "graph_id int, src string, dst string")
    near = {}
    for g, a, b in rows:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)

    def distances(g, start):
        out, line = ({start: 0}, deque([start])) if (g, start) in near else ({}, deque())
        while line:
            at = line.popleft()
            for b in near[g, at]:
                if b not in out:
                    out[b] = out[at] + 1
                    line.append(b)
        return out

    asked = [(g, f"n{a:02}", f"n{b:02}") for g in range(6) for a, b in ((0, 13), (3, 3), (5, 2), (1, 99))]
    nodes = components.path_nodes(pairs, spark.createDataFrame(asked, "graph_id int, src string, dst string"))
    got = {}
    for r in nodes.collect():
        got.setdefault((r.graph_id, r.src, r.dst), {})[r.pos] = r.node
    for g, a, b in asked:
        far = distances(g, a)
        if b not in far:
            assert (g, a, b) not in got
            continue
        path = [b]
        while path[-1] != a:
            path.append(min(x for x in near[g, path[-1]] if far.get(x) == far[path[-1]] - 1))
        assert [got[g, a, b][k] for k in range(len(path))] == path[::-1]
    shown = pairs.filter("src <> 'n00'").withColumn("edge_id", pairs.src)
    hops = components.path_edges(nodes, shown).collect()
    assert len(hops) == sum(len(p) - 1 for p in got.values())
    assert all(r.is_broken == (min(r.from_node, r.to_node) == "n00") and r.edge_id in (None, min(r.from_node, r.to_node)) for r in hops)

    sets = [(g, s, side, f"n{rng.randrange(16):02}") for g in range(6) for s in range(3) for side in ("from", "to") for _ in range(3)]
    best = components.best_ends(pairs, spark.createDataFrame(sets, "graph_id int, set_id int, side string, node string")).collect()
    want = {}
    for g in range(6):
        for s in range(3):
            start, end = ([x[3] for x in sets if x[:3] == (g, s, side)] for side in ("from", "to"))
            every = [(distances(g, a)[b], a, b) for a in start for b in end if a != b and b in distances(g, a)]
            if every:
                want[g, s] = min(every)
    assert {(r.graph_id, r.set_id): (r.hops, r.src, r.dst) for r in best} == want
