import random

import corpus_pipeline
from weftgraph.llm import registry


def test_stages_end_to_end(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(3, 8)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    item = text(14)
    rows = [(i, text()) for i in range(60)]
    junk = {i for i in range(0, 60, 4)}
    rows = [(i, " | ".join(w.upper() + "!!" for w in t.split()) if i in junk else t) for i, t in rows]
    rows += [(70, rows[1][1].upper()), (71, rows[2][1] + " tail"), (72, text(20) + " " + item + " " + text(20)), (73, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        left.append({r.doc_id for r in now.select("doc_id").collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == docs.columns
    good, unique, apart, clean, mixed = left
    assert not good & junk and good >= set(range(60)) - junk
    assert good - unique == ({1} if 70 in good else set()) and unique - apart == ({71} if 71 in unique else set())
    assert apart - clean == {72} and mixed == clean
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {r.doc_id: r.taken for r in now.collect()}


def test_registry():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 11)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def written(spark, path, docs, labels=(), items=()):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0


def test_repeated_rows_and_rows_without_an_id(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, None), (2, ""), (3, "É " + c)]
    sf = written(spark, tmp_path, [(i, t, None, None, None) for i, t in rows], items=[(None, None), (1, "")])
    got = sorted((str(r.doc_id), r.size) for r in corpus_pipeline.run(spark, sf).collect())
    # of copies one stays, of near copies the least id; a text that only shares an id with another stays
    assert got == [("1", 30), ("2", 0), ("2", 30), ("None", 30)]
