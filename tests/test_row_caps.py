import numpy as np

from weftgraph.operators import components, vectors


def test_queries_in_sets(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<double>").repartition(3)
    asked = items.filter("item < 23").withColumnRenamed("item", "query")
    want = {(q, int(i)): r for q in range(23) for r, i in enumerate(np.argsort(-(x @ x[q]), kind="stable")[:3], 1)}
    for size in (7, 23, 100):
        got = vectors.top_k_blocks(asked, items, 3, -100.0, max_queries=size).collect()
        assert {(r["query"], r["item"]): r["rank"] for r in got} == want and len(got) == len(want)
    assert vectors.top_k_blocks(asked.limit(0), items, 3, -100.0).count() == 0


def test_hops_beyond_a_hundred(spark):
    line = [(1, f"n{i}", f"n{i + 1}") for i in range(102)]
    pairs = spark.createDataFrame(line, "graph_id int, src string, dst string").coalesce(1)
    got = components.hop_counts(pairs, spark.createDataFrame([(1, "n0")], "graph_id int, source string"))
    assert {r.node: r.hops for r in got.collect()} == {f"n{i}": i for i in range(103)}
