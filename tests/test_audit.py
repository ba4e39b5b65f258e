import random

from pyspark.sql import functions as F

from weftgraph.operators import audit, facts, metrics, repair, retrieve
from weftgraph.plans import flows
from weftgraph.operators.hypergraph import hyperedges

from test_graph import FACT

SAMPLE = (
    "graph_id int, question string, answer string, hop_type string, gold array<struct<pos:int,title:string,sent_ids:array<int>>>, "
    "question_entities array<string>, parse_failures long"
)
CHUNK = "graph_id int, chunk_idx int, chunk_id string, title string, sentences array<string>, gold_sentence_offsets array<int>"


def audited(spark, links, titles, samples):
    """links: (chunk, a, b); titles: of chunks, by number."""
    chunks = spark.createDataFrame([(1, i, f"c{i}", t, [f"{t} said"], []) for i, t in enumerate(titles)], CHUNK)
    edges = hyperedges(spark.createDataFrame([(1, c, k, f"c{c}", [a, b], "r", 0, 1.0, ["x"], []) for k, (c, a, b) in enumerate(links)], FACT))
    graph = flows.graph_of(edges, chunks)
    return flows.audit_reports(spark.createDataFrame(samples, SAMPLE), graph), graph


def sample(answer, titles, asked, kind="bridge"):
    return (1, "q?", answer, kind, [(i, t, [0]) for i, t in enumerate(titles)], asked, 0)


def test_skip_ahead_heals(spark):
    # the source is linked to T2 only; T1's nodes are apart
    links = [(0, "x1", "x2"), (1, "src", "y1"), (1, "y1", "goal")]
    (reports, chains), _ = audited(spark, links, ["T1", "T2"], [sample("goal", ["T1", "T2"], ["src"])])
    r = reports.first()
    assert (r.failure_mode, r.num_heals, r.total_broken_hops, r.is_answerable, r.is_clean) == ("healed", 1, 1, True, False)
    line = chains.first().segments
    assert [(s.from_node, s.to_node, s.is_broken, s.is_fallback) for s in line] == [("src", "T1", True, False), ("src", "T2", False, True)]


def test_same_single_node_is_no_path(spark):
    links = [(0, "a", "b"), (1, "src", "t")]
    (reports, chains), _ = audited(spark, links, ["A", "src"], [sample("b", ["src"], ["t"])])
    # the title's nodes hold another node beside the source's, so the first segment holds; the answer is apart
    assert reports.first().failure_mode == "broken_terminal" and not chains.first().segments[0].is_broken


def test_early_verdicts_and_predicates(spark):
    links = [(0, "a", "b"), (0, "b", "c")]
    for s, mode in (
        (sample("c", ["T"], []), "no_question_entities"), (sample("c", ["T"], ["zz"]), "src_unresolved"),
        (sample("Yes", ["T"], ["a"]), "predicate_ok"), (sample("nowhere", ["T"], ["a"]), "answer_not_entity"),
        (sample("c", ["T"], ["a"], "other"), "broken_mid_chain"), (sample("yes", ["U"], ["a"], "comparison"), "predicate_broken"),
        (sample("c", ["T"], ["a"]), "connected"), (sample("c", [], ["a"], "comparison"), "broken_mid_chain"),
    ):
        (reports, _), _ = audited(spark, links, ["T"], [s])
        assert reports.first().failure_mode == mode, s


def test_comparison_keeps_audit_rows(spark):
    links = [(0, "a", "b"), (1, "c", "d")]
    (reports, chains), _ = audited(spark, links, ["A Title", "C Title"], [sample("yes", ["A Title", "C Title"], ["a", "c", "left over"], "comparison")])
    got = chains.orderBy("chain_pos").collect()
    assert len(got) == 3 and got[2].terminal is None and got[2].segments[0].to_node == "???"
    assert reports.first().num_reasoning_chains == 3


def test_worst_mode(spark):
    df = spark.createDataFrame([(1, ["connected", "broken_terminal"]), (2, [])], "i int, m array<string>")
    assert [r.w for r in df.orderBy("i").select(audit.worst_mode(F.col("m")).alias("w")).collect()] == ["broken_terminal", "broken_mid_chain"]


def test_skip_ahead_fold_against_a_loop(spark):
    rng = random.Random(5)
    cases = []
    for i in range(60):
        sets = []
        for k in range(rng.randrange(1, 6)):
            parts = sorted({(f"c{rng.randrange(3)}", f"n{k}{i}", f"m{k}{i}") for _ in range(rng.randrange(3))}, key=lambda p: p[0])
            sets.append((f"w{k}", ([p[1] for p in parts], parts)))
        cases.append((i, sets))
    df = spark.createDataFrame(cases, f"i int, w array<struct<label:string,set:{audit.SET}>>")
    got = {r.i: [(s.from_node, s.to_node, s.is_broken, s.is_fallback) for s in r.s] for r in df.select("i", audit.segments(F.col("w")).alias("s")).collect()}
    meet = lambda a, b: any(x[0] == y[0] for x in a[1][1] for y in b[1][1])
    for i, w in cases:
        out, at = [], 0
        while at < len(w) - 1:
            if meet(w[at], w[at + 1]):
                out.append((w[at][0], w[at + 1][0], False, False))
            else:
                out.append((w[at][0], w[at + 1][0], True, False))
                if at + 2 < len(w) and meet(w[at], w[at + 2]):
                    out.append((w[at][0], w[at + 2][0], False, True))
                    at += 1
            at += 1
        assert got[i] == out


def test_repair_finds_the_missing_link(spark):
    links = [(0, "Ada", "Byron"), (1, "Babbage", "Engine")]
    (reports, chains), graph = audited(spark, links, ["T", "U"], [sample("engine", ["T"], ["ada"])])
    assert reports.first().failure_mode == "broken_terminal"

    class Told(facts.RuleExtractor):
        def targeted(self, sentences, src, dst, goal):
            return '[{"entities":["Ada","Babbage"],"relation":"knew","sentence_index":0,"confidence":1.0}]'

    samples = spark.createDataFrame([sample("engine", ["T"], ["ada"])], SAMPLE)
    before, after, tries = flows.repair_validation(samples, graph, Told())
    assert after.first().failure_mode == "connected"
    t = tries.first()
    # the edge is found in the chunks of either end
    assert (t.kind, t.status, t.new_edges, t.chunks_read) == ("terminal", "found_facts", 2, ["c0", "c1"])
    outcome = metrics.repair_outcomes(
        before.withColumnRenamed("sample_id", "graph_id"), after.withColumnRenamed("sample_id", "graph_id"), spark.createDataFrame([(1, 2)], "graph_id int, new_edges int")
    )
    assert {r.measure: r.n for r in outcome.collect()}["flipped"] == 1
    assert repair.primary_gaps(samples, chains).first().src_options == ["T"]


def test_agent_tool():
    tool = repair.GraphRepair(lambda src, dst: {"new_edges": 1})
    assert tool.execute({"src": "a", "dst": "b"}) == '{"new_edges": 1}'
    assert "blank" in tool.execute({"src": " ", "dst": "b"}) and "missing" in tool.execute({"src": "a"})
    assert tool.validate({"src": 1, "dst": "b"})[0] is False and tool.reward({}, "") == 0.0
    assert tool.execute_batch([{"src": "a", "dst": "b"}] * 2) == ['{"new_edges": 1}'] * 2


def test_beam_keeps_double_candidates(spark):
    edges = spark.createDataFrame(
        [(1, "e1", 0.9, ["a", "b"]), (1, "e2", 0.8, ["a", "c"]), (1, "e3", 0.1, ["b", "d"])], "graph_id int, edge_id string, score double, entities array<string>"
    )
    starts = spark.createDataFrame([(1, "a"), (1, "b")], "graph_id int, entity_id string")
    got = retrieve.beam_search(edges, starts, hops=1, beam=2, least=0.15).orderBy("place").collect()
    # e1 stands at both nodes of the frontier and fills the beam
    assert [(r.edge_id, r.score) for r in got] == [("e1", 0.9), ("e1", 0.9)]


def test_evidence(spark):
    chunks = spark.createDataFrame([(1, 0, "c0", "t", [" the cat sat ", "dogs bark"], []), (1, 1, "c1", "t", ["the cat sat", " "], [])], CHUNK)
    asked = spark.createDataFrame([(1, "where did the cat sit")], "graph_id int, question string")
    got = retrieve.text_evidence(asked, chunks, k=2).orderBy("rank").collect()
    assert got[0].sentence == "the cat sat" and len({r.sentence for r in got}) == len(got)
    conditions = retrieve.contexts(asked, {"text_rag": retrieve.text_evidence(asked, chunks, k=1)})
    assert {r.condition: r.facts for r in conditions.collect()} == {"closed_book": [], "text_rag": ["the cat sat"]}


def test_scores(spark):
    df = spark.createDataFrame([("a b a", "a"), ("the", "the"), ("The Eiffel Tower!", "eiffel tower"), ("x y y", "y z")], "pred string, gold string")
    assert [(r.em, round(r.f1, 4)) for r in metrics.scored_answers(df).collect()] == [(0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (0.0, 0.4)]
    pairs = spark.createDataFrame([("y", "y"), ("y", "n"), ("n", "n"), ("u", "u")], "a string, b string")
    k = metrics.agreement(pairs).first()
    assert (k.raw, k.expected, k.kappa, k.strength) == (0.75, 0.3125, 0.636364, "moderate")
