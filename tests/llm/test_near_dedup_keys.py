from weftgraph.llm import jaccard


def words(prefix, n=60):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_other_texts_of_a_removed_id_stay(docs_of):
    a, b = words("a"), words("b")
    rows = [(5, a), (None, a + " tail"), (None, words("c")), (None, None), (3, b), (7, b + " tail"), (7, words("d")), (7, None)]
    left = jaccard.near_dedup(docs_of(rows))
    got = sorted((str(r.doc_id), str(r.text)) for r in left.collect())
    want = [rows[i] for i in (0, 2, 3, 4, 6, 7)]
    assert got == sorted((str(i), str(t)) for i, t in want) and left.columns == docs_of(rows).columns


def test_one_row_of_a_group_under_one_id(docs_of):
    a, b = words("a"), words("b")
    rows = [(7, a), (7, a + " tail"), (None, b), (None, b), (None, b + " tail"), (8, None), (8, None), (9, words("e"))]
    got = [(r.doc_id, r.text) for r in jaccard.near_dedup(docs_of(rows)).collect()]
    assert len([t for i, t in got if i == 7]) == 1 and len([t for i, t in got if i is None]) == 1
    assert len([t for i, t in got if i == 8]) == 2 and (9, words("e")) in got and len(got) == 5
