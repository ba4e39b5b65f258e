import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import facts
from weftgraph.sources import backends
from weftgraph.streaming.edges import edge_counts, stream_edges

GOOD = {"entities": ["a", "b"], "relation": "r", "sentence_index": 0, "confidence": 1}


@pytest.fixture(scope="module")
def reasons(spark):
    def run(*items):
        df = spark.createDataFrame([(str(i), x if isinstance(x, str) else json.dumps(x), ["s", "t"]) for i, x in enumerate(items)], "chunk_id string, raw string, sentences array<string>")
        got: dict = {}
        for r in facts.checked_facts(df).collect():
            got.setdefault(int(r.chunk_id), []).append("parse_failed" if r.parse_failed else r.reason)
        return [got.get(i, []) for i in range(len(items))]

    return run


def test_validation_order(reasons):
    bad = [
        ({"sentence_index": True}, "bad_sentence_index"), ({"sentence_index": 1.0}, "bad_sentence_index"), ({"sentence_index": -1}, "index_out_of_range"),
        ({"sentence_index": 2}, "index_out_of_range"), ({"confidence": True}, "bad_confidence"), ({"confidence": 1.5}, "bad_confidence"),
        ({"entities": ["a"]}, "too_few_entities"), ({"entities": list("abcdefg")}, "too_many_entities"), ({"relation": " <x>"}, "placeholder_relation"),
        ({"entities": ["a", " "]}, "blank_entity"), ({"entities": ["a", 1]}, "blank_entity"), ({"relation": ""}, "bad_relation"), ({"relation": None}, "bad_relation"),
        ({"entities": None}, "bad_entity_list"), ({"confidence": None}, "bad_confidence"), ({"sentence_index": "0"}, "bad_sentence_index"),
    ]
    got = reasons([GOOD, *({**GOOD, **change} for change, _ in bad), "bare"])
    assert got[0] == [None, *(why for _, why in bad), "not_a_dict"]


def test_responses_that_are_no_list(reasons):
    assert reasons(GOOD, "no json", "[]", "<think>[1]</think>```json\n[]\n```", "42") == [["not_a_dict"], ["parse_failed"], [], [], ["not_a_dict"]]


def test_extraction_asks_once_for_equal_chunks(spark, tmp_path):
    class Counting(facts.RuleExtractor):
        def facts(self, sentences):
            with open(tmp_path / "calls", "a") as f:
                f.write("x")
            return super().facts(sentences)

    rows = [(1, i, f"1_{i}", "t", ["Ada met Byron"] if i < 3 else ["Nobody here"], []) for i in range(4)]
    chunks = spark.createDataFrame(rows, "graph_id int, chunk_idx int, chunk_id string, title string, sentences array<string>, gold_sentence_offsets array<int>")
    extracted = facts.extract(chunks, Counting())
    answered = facts.with_content(chunks, extracted)
    assert (tmp_path / "calls").read_text() == "xx" and answered.count() == 4
    assert answered.filter("asked").count() == 2
    checked = facts.checked_facts(answered.select("chunk_id", "raw", "sentences"))
    assert facts.facts_from(checked).count() == 3
    assert {r.measure: r.n for r in facts.extractor_stats(checked).collect()} == {"valid": 3}


def test_failures_are_charged_to_the_first_chunk(spark):
    class Mute(facts.RuleExtractor):
        def facts(self, sentences):
            return None

    chunks = spark.createDataFrame([(g, 0, f"{g}_0", ["x"]) for g in (1, 2)], "graph_id int, chunk_idx int, chunk_id string, sentences array<string>")
    answered = facts.with_content(chunks, facts.extract(chunks, Mute(), retries=1, delay=0))
    failed = facts.parse_failures(facts.checked_facts(answered.select("chunk_id", "raw", "sentences")), answered)
    assert {r.graph_id: r.parse_failures for r in failed.collect()} == {1: 1, 2: 0}


def test_question_entities_skip_known(spark):
    asked = spark.createDataFrame([(1, "Did Ada meet Byron?"), (2, "who?")], "graph_id int, question string")
    known = spark.createDataFrame([(2, ["kept"])], "graph_id int, entities array<string>")
    got = {r.graph_id: r.entities for r in facts.question_entities(asked, facts.RuleExtractor(), known).collect()}
    assert got[2] == ["kept"] and "Byron" in got[1]


def test_unavailable_extractor_is_refused(spark):
    class Off(facts.RuleExtractor):
        def is_available(self):
            return False

    with pytest.raises(RuntimeError):
        facts.extract(spark.createDataFrame([(["x"],)], "sentences array<string>"), Off())


def test_backend_bodies():
    with pytest.raises(ValueError):
        backends.ChatCompletions("m", structured_output="other")
    body = backends.ChatCompletions("m", structured_output="response_format").body("p", facts.FACT_SCHEMA, 5, 0.3)
    assert body["response_format"]["json_schema"]["schema"] == facts.FACT_SCHEMA and body["temperature"] == 0.3
    assert backends.LocalChat("m").body("p", {}, 5, 0.3)["options"] == {"temperature": 0.3, "num_predict": 5}
    assert not backends.ChatCompletions("m", "http://127.0.0.1:9").is_available() and not backends.LocalChat("m", "http://127.0.0.1:9").is_available()


def test_streamed_edges_are_deduplicated(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, "c", ["a", "B "], "r", "2024-01-01 00:00:00"), (1, "c", ["b", "A"], "R", "2024-01-01 00:10:00"), (1, "c", ["a", "a"], "r", "2024-01-01 00:00:00")]
    schema = "graph_id int, chunk_id string, raw_entities array<string>, relation string, at timestamp"
    df = spark.createDataFrame(rows, "graph_id int, chunk_id string, raw_entities array<string>, relation string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(source))
    run = stream_edges(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName("edges_out").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = spark.table("edges_out")
    assert got.count() == 1
    assert edge_counts(got.withColumn("at", F.col("at"))).first().edges == 1
