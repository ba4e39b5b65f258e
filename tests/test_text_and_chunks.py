import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import chunking
from weftgraph.plans import queries
from weftgraph.sources import qa


def one(spark, col, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(col).first()[0]


def test_normalize_takes_all_white_space(spark):
    assert one(spark, text.normalize(F.col("x")), x=" \t Ada Lovelace \n") == "ada lovelace"


@pytest.mark.parametrize(
    ("answer", "sentences", "expected"),
    [
        ("no", ["Nolan is known"], False), ("D.C.", ["in D.C. today"], False), ("nolan", ["Nolan is known"], True), ("", ["x"], False),
        ("a+b", ["see a+b there"], True), (r"x\E", [r"an x\E y"], True), ("café", ["le Café noir"], True), ("caf", ["le Café noir"], False),
    ],
)
def test_grounding(spark, answer, sentences, expected):
    assert one(spark, text.grounded(F.col("a"), F.col("s")), a=answer, s=sentences) is expected


def test_content_key_minds_borders(spark):
    key = text.content_key(F.col("s"))
    assert one(spark, key, s=["a b", "c"]) != one(spark, key, s=["a", "b c"])


def test_answer_form_and_prompts(spark):
    assert one(spark, text.normalize_answer(F.col("x")), x="The Eiffel Tower!") == "eiffel tower"
    assert one(spark, text.verbalize(F.col("e"), F.lit("born_in")), e=["a", "b"]) == "a --[born in]--> b"
    assert one(spark, text.verbalize(F.col("e"), F.lit("born_in")), e=["a", "b", "c"]) == "born in(a, b, c)"
    assert one(spark, text.numbered(F.col("e")), e=["a", "b"]) == "[0] a\n[1] b"
    assert "Goal" not in one(spark, text.repair_prompt(F.col("e"), F.lit("s"), F.lit("t"), F.lit("  ")), e=["a"])
    assert one(spark, text.first_line(F.col("x")), x="\n first\nsecond") == "first"
    assert one(spark, text.file_name(F.col("x")), x="a/b:c_1-2") == "a_b_c_1-2"


def rows(spark, sentences, gold=()):
    schema = "graph_id long, article_pos int, title string, sentences array<string>, gold array<int>"
    return spark.createDataFrame([(1, 0, "t", sentences, list(gold))], schema)


def test_windows_keep_the_contained_tail(spark):
    chunks = chunking.sentence_chunks(rows(spark, list("abcde"), [0, 4, 9])).orderBy("chunk_idx").collect()
    assert [(c.start_sentence, len(c.sentences), c.gold_sentence_offsets) for c in chunks] == [(0, 5, [0, 4]), (4, 1, [0])]
    assert [c.chunk_id for c in chunks] == ["1_0", "1_1"]
    assert chunking.sentence_chunks(rows(spark, [])).count() == 0


def test_overlap_of_a_whole_window_is_refused():
    with pytest.raises(ValueError):
        chunking.check_window(3, 3)


RAW = [
    {
        "id": "q1", "question": "Who &amp; what?", "answer": "A &lt; B", "type": "bridge", "level": "easy",
        "supporting_facts": {"title": ["T&amp;1", "T2", "T&amp;1"], "sent_id": [0, 1, 2]},
        "context": {"title": ["T&amp;1", "T2", "extra"], "sentences": [["a &amp; b.", "c.", "d."], ["e.", "f."]]},
    }
]


def test_samples_and_articles(spark, tmp_path):
    import json

    path = tmp_path / "q.jsonl"
    path.write_text("\n".join(map(json.dumps, RAW)))
    own, chunks = qa.load_chunks(spark, str(path), 5, 1, cache=str(tmp_path / "cache"))
    s = own.first()
    assert (s.question, s.answer) == ("Who & what?", "A < B")
    assert [(g.title, list(g.sent_ids)) for g in s.gold] == [("T&1", [0, 2]), ("T2", [1])]
    got = {c.title: c for c in chunks.collect()}
    assert set(got) == {"T&1", "T2"}
    assert list(got["T&1"].sentences) == ["a & b.", "c.", "d."] and list(got["T&1"].gold_sentence_offsets) == [0, 2]
    again, _ = qa.load_chunks(spark, str(path), 5, 1, cache=str(tmp_path / "cache"))
    assert again.count() == 1
    qa.load_chunks(spark, str(path), 3, 1, cache=str(tmp_path / "cache"))
    assert len([p for p in (tmp_path / "cache" / "chunks").iterdir() if p.is_dir()]) == 2
    assert chunking.dataset_summary(own, chunks).first().avg_chunks == 2.0


def test_graph_cache_and_records(spark, tmp_path):
    nodes, edges = spark.range(2), spark.range(3)
    a, b = qa.graph_or_build(spark, str(tmp_path / "g"), lambda: (nodes, edges))
    assert (a.count(), b.count()) == (2, 3)
    a, b = qa.graph_or_build(spark, str(tmp_path / "g"), lambda: 1 / 0)
    assert (a.count(), b.count()) == (2, 3)
    qa.write_records(spark.createDataFrame([("s", "bridge")], "sample_id string, hop_type string"), str(tmp_path / "r"))
    assert qa.read_reports(spark, str(tmp_path / "r")).first().sample_id == "s"


def test_titles_have_markup_signs_alone_resolved(spark, tmp_path):
    titles = {1: "a &lt;b&gt; &amp;lt; &amp;amp;", 2: "x = &quot;1&quot; &#39;", 3: "cut off &amp", 4: "&lt &gt &copy;", 5: ""}
    pages = [(k, f"<html><title>{t}</title>") for k, t in titles.items()] + [(6, None), (7, "no title")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in queries.q55_unescaped_titles(spark, str(tmp_path)).collect()}
    assert got == {1: "a <b> &lt; &amp;", 2: titles[2], 3: titles[3], 4: titles[4], 5: "", 6: None, 7: ""}
    duckdb = pytest.importorskip("duckdb")
    sql = queries.ORACLE_SQL["q55_unescaped_titles"].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(duckdb.sql(sql).fetchall())


def test_unescape_resolves_every_reference(spark):
    df = spark.createDataFrame([("&quot;a&quot; &#39; &amp &copy;",), (None,)], "t string")
    assert [r.u for r in df.select(chunking.unescape("t").alias("u")).collect()] == ['"a" \' & ©', None]
