import hashlib
import random
from collections import defaultdict

import pytest

from weftgraph.llm import exact_dedup, mixing

ROWS = [
    (1, "Hello World"), (2, "hello world"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "z" * 50_000), (8, "Z" * 50_000), (9, "one"),
    (10, "hello  world"), (11, "HELLO WORLD"), (None, "one"), (None, "alone"),
]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[fold(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "tag"), [(64, 64), (1, 64), (1, 1), (4, 0)])
def test_groups_with_collisions(docs_of, bits, tag):
    rows = ROWS + [(100 + i, f"text {i % 7}") for i in range(40)]
    got = exact_dedup.exact_groups(docs_of(rows), capacity=2, key_bits=bits, tag_chars=tag).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_keep_one(docs_of):
    docs = docs_of([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None)])
    assert sorted((r.doc_id, r.kept) for r in exact_dedup.exact_groups(docs).collect()) == [(1, False), (1, True), (1, True), (2, False), (2, True)]
    left = exact_dedup.exact_dedup(docs)
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "a"), (1, "b"), (2, "")] and left.columns == docs.columns


def test_dedup_keeps_the_largest_id(docs_of):
    left = exact_dedup.exact_dedup(docs_of(ROWS)).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [4, 5, 6, 8, 9, 10, 11, None]))


def test_empty(docs_of):
    assert exact_dedup.exact_groups(docs_of([])).count() == 0 and exact_dedup.exact_dedup(docs_of([])).count() == 0
    assert mixing.mix(docs_of([])).count() == 0


def buckets_of(docs, capacity, **more):
    index = exact_dedup.index_entries(docs, more.get("key_bits", 64))
    shared = exact_dedup.cut(index.groupBy("key").count().filter("count > 1").select("key"))
    return exact_dedup.build(docs, shared, capacity, **more)


def test_overfull_buckets_are_split_on_disk(spark, docs_of):
    docs = docs_of([(i, f"text {i % 60}") for i in range(240)], parts=1)
    files = buckets_of(docs, 2)
    first = min(files.depths)
    assert len(files.depths) > 1 and files.dead[first]  # loaded at one depth, split to others
    rows = files.live(spark).collect()
    assert len(rows) == 60 and sum(r.n for r in rows) == 240
    fill = defaultdict(list)
    for r in rows:
        assert r.bucket == (r.key % 2**64) >> (64 - r.depth)
        fill[r.depth, r.bucket].append(r)
    assert all(len(v) <= 2 for v in fill.values())
    # untouched buckets are shared by several slots of the directory
    assert {d for d, _ in fill} != {max(files.depths)}


def test_owners_chain_collisions_and_compare_bytes(spark, docs_of):
    docs = docs_of([(i, f"text {i % 30}") for i in range(90)], parts=3)
    files = buckets_of(docs, 4, key_bits=2, tag_chars=0)
    links = exact_dedup.chains(files, spark).collect()
    assert len(links) == 30 and {r.group_size for r in links} == {3} and {r.keep_id for r in links} == set(range(60, 90))
    chain = defaultdict(list)
    for r in links:
        chain[r.key].append(r.link)
    assert len(chain) <= 4 and all(sorted(v) == list(range(1, len(v) + 1)) for v in chain.values())
    # a bucket of one key can't be split, however full
    keys = defaultdict(list)
    for r in files.live(spark).collect():
        keys[r.depth, r.bucket].append(r.key)
    assert all(len(v) <= 4 or len(set(v)) == 1 for v in keys.values()) and max(map(len, keys.values())) > 4


def test_hot_text_leaves_few_entries(spark, docs_of):
    docs = docs_of([(i, "the same" if i % 3 else f"other {i // 2}") for i in range(900)], parts=40)
    hot = [r for r in buckets_of(docs, 1000).live(spark).collect() if r.norm == "the same"]
    assert len(hot) <= exact_dedup.SALTS and sum(r.n for r in hot) == 600


def water(sizes, weights):
    """Targets by dealing and capping again and again."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while True:
        rest = total - sum(3 * sizes[i] for i in range(len(sizes)) if i not in open_)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 3 * sizes[i]}
        if not over:
            break
        open_ -= over
    for i in range(len(sizes)):
        out[i] = share[i] if i in open_ else 3.0 * sizes[i]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_against_water_filling(docs_of, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "B", "é", None]
    heavy = [rng.choice([1, 1, 30, 200]) for _ in names]
    rows = [(i, " ".join(["w"] * rng.randrange(40)) if rng.random() > 0.05 else None, rng.choices(names, heavy)[0]) for i in range(600)]
    got = mixing.mix(docs_of(rows), range_rows=17).collect()
    sizes = {n: sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names if any(s == n for _, _, s in rows)}
    order = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    want = dict(zip(order, water([sizes[n] for n in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    source, taken = {i: s for i, _, s in rows}, defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(docs_of(rows, parts=5), range_rows=17).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_of_wordless_documents(docs_of):
    got = mixing.mix(docs_of([(1, None, None), (2, " \t", "a"), (2, " \t", "a")])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
