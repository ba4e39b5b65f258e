import random
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.llm import jaccard
from weftgraph.llm.components import components


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute(rows, n, percent):
    sets, lead = sets_of(rows, n), list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                lead[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 60, 3), (4, 85, 4)])
def test_against_all_pairs(docs_of, n, percent, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n ", "One two", "one TWO", "one two three", "éa b c d", "ÉA b c d", "long " * 30_000]
    shared = [rng.choice(words) for _ in range(25)]
    for _ in range(6):
        texts += family(rng, [rng.choice(words) for _ in range(rng.randrange(5, 90))], rng.randrange(2, 14), 4)
    texts += [" ".join(shared + [rng.choice(words) for _ in range(rng.randrange(8))]) for _ in range(25)]
    texts += texts[20:26]
    rows = list(enumerate(texts))
    rows += [rows[10], (11, "one two")]
    got = jaccard.jaccard_groups(docs_of(rows), n, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, n, percent)


def test_star_around_a_centre(docs_of):
    # copies that differ from the centre at places of their own: linked to it, not to each other
    base = [f"b{i}" for i in range(100)]
    rows = [(50, " ".join(base))]
    for k in range(12):
        w = list(base)
        w[8 * k + 2] = w[8 * k + 5] = f"edit{k}"
        rows.append((k, " ".join(w)))
    got = jaccard.jaccard_groups(docs_of(rows), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)


def test_one_of_each_group_stays(docs_of):
    base = " ".join(f"b{i}" for i in range(60))
    docs = docs_of([(1, base), (2, base + " more"), (3, "apart from it all here"), (4, None), (5, None), (3, "apart from it all here")])
    left = jaccard.near_dedup(docs)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5] and left.columns == docs.columns


def test_empty(docs_of):
    assert jaccard.jaccard_groups(docs_of([])).count() == 0 and jaccard.near_dedup(docs_of([])).count() == 0


def test_filters_never_drop_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert jaccard.suffix_bound(a, b) >= both
        if len(b):
            assert jaccard.linked(a, b, 80) == (100 * both >= 80 * (len(a) + len(b) - both))
            if jaccard.linked(a, b, 80):
                counts = np.zeros(jaccard.COUNTS, np.uint32)
                assert set(jaccard.prefix(a, counts, 80)) & set(jaccard.prefix(b, counts, 80))


def test_components_of_a_long_path(spark):
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(120) if i % 40 != 39] + [("900", "900")]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len(got) == 120 and all(c == f"{int(n) // 40 * 40:03}" for n, c in got.items())


def test_postings_without_partners_go(spark):
    rng = random.Random(6)
    sizes = {k: rng.choice([1, 2, 5, 40]) for k in range(30)}
    rows = [(k, bytes([k, i]) * 8, rng.randrange(20, 60), rng.randrange(4), bytes([k, i % 3]) * 8) for k, m in sizes.items() for i in range(m)]
    named = spark.createDataFrame(rows, "shingle long, class binary, n int, pos int, component binary")
    own = {longest: {(r.shingle, bytes(r["class"])) for r in jaccard._open(named, 85, longest).collect()} for longest in (3, 10, 512)}

    def fits(x, y):
        # each class has one posting, so shares nothing before it, and after it what follows a prefix at most
        beyond = max(-(-85 * r[2] // 100) - 1 for r in (x, y))
        most = 1 + min(beyond, x[2] - x[3] - 1, y[2] - y[3] - 1)
        return x[4] != y[4] and 100 * min(x[2], y[2]) >= 85 * max(x[2], y[2]) and 100 * most >= 85 * (x[2] + y[2] - most)

    exact = {(x[0], x[1]) for x in rows for y in rows if x[0] == y[0] and fits(x, y)}
    assert own[512] == exact
    for longest in (3, 10):  # a long shingle stays whole where it goes on beyond what is held
        assert exact <= own[longest] <= {(x[0], x[1]) for x in rows if sizes[x[0]] > longest} | exact
