import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from weftgraph.llm import quality, repeats


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        b, gone = (text or "").encode(), bytearray(len((text or "").encode()))
        for p in range(len(b) - length + 1):
            own = b[p : p + length]
            if own in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(own)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, long = text(180), text(1500)
    rows = [None, "", "short", "a" * 400, "ab" * 300, long, long, long + "x", "y" + long, long[:700] + "#" + long[700:], long[:99], long[300:400]]
    rows += [text(rng.randrange(150)) + passage + text(rng.randrange(150)) for _ in range(25)]
    rows += [text(rng.randrange(60)) + passage[k : k + 110] + text(rng.randrange(60)) for k in range(0, 70, 7)]
    rows += [text(400) for _ in range(10)] + [passage * 4, "é" * 300]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "hot", "index"), [(1, 20_000, 1 << 21), (2, 2, 1 << 21), (3, 20_000, 500), (4, 8, 2000)])
def test_against_search(docs_of, seed, hot, index):
    rows = corpus(seed)
    got = repeats.remove_repeats(docs_of(rows, parts=4), bits=20, hot=hot, index_bytes=index)
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute(rows, 100)


def test_pieces_of_a_long_text(docs_of, monkeypatch):
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, body), (2, body[1700:3900] + body), (3, "z" + body)]
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert sum(len(e) for _, e, _ in repeats.pieces([body.encode()])) == 8
    got = repeats.remove_repeats(docs_of(rows), bits=20)
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute(rows, 100)


def test_a_full_filter_changes_nothing(docs_of):
    rows = corpus(7)
    got = repeats.remove_repeats(docs_of(rows), bits=9)
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute(rows, 100)


def test_repeated_rows_and_null_ids(docs_of):
    rng = random.Random(3)
    text, other = ("".join(rng.choice("abcdefgh ") for _ in range(250)) for _ in range(2))
    rows = [(2, text), (2, text), (None, text), (5, text), (7, other), (7, other)]
    for parts in (1, 4):
        got = repeats.remove_repeats(docs_of(rows, parts), bits=20).collect()
        # the null id comes first; rows given twice are one document
        assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("2", 250), ("2", 250), ("5", 250), ("7", 0), ("7", 0), ("None", 0)]
    assert repeats.remove_repeats(docs_of([]), bits=20).count() == 0


def phrases_of(seed):
    rng = random.Random(seed)
    out = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(100, 160))) for _ in range(6)]
    return [*out, out[0][5:120], out[2][:100] + b"zz", out[1] + out[3], b"a" * 130, b"a" * 100 + b"b"]


def repeats_by_search(phrases):
    seen, out = set(), []
    for k, own in enumerate(phrases):
        for p in range(len(own) - 99):
            if own[p : p + 100] in seen:
                out.append((k, p))
            seen.add(own[p : p + 100])
    return out


def streamed(index, phrases):
    got = [(int(k), int(p)) for who, at, first in index.stream(phrases) for k, p, f in zip(who, at, first, strict=True) if f < index.starts[k] + p]
    return sorted(got)


@pytest.mark.parametrize("seed", range(5))
def test_run_index_finds_the_first_place(seed):
    phrases = phrases_of(seed)
    index = repeats.RunIndex(phrases, 100)
    data = b"".join(x + b"\xff" for x in phrases)
    for who, at, first in index.stream(phrases):
        for k, p, f in zip(who, at, first, strict=True):
            assert f == min(index.starts[i] + x.find(phrases[k][p : p + 100]) for i, x in enumerate(phrases) if phrases[k][p : p + 100] in x)
    assert streamed(index, phrases) == repeats_by_search(phrases)
    assert len(index.heads) == len(index.samples) == len(index.keys) < len(data)


def test_an_index_takes_little_memory():
    rng = random.Random(1)
    words = [rng.randbytes(140) for _ in range(300)]
    rows = [(k, 0, 0, rng.choice(words)[: rng.randrange(100, 141)] + rng.randbytes(30)) for k in range(4000)]
    tracemalloc.start()
    assert list(repeats.indexed_repeats([rows], 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * sum(len(r[3]) for r in rows)  # 146 before


def test_segments_are_handed_over_in_small_batches():
    best, rng = repeats.Best(), random.Random(2)
    found = {}
    for k in range(40_000):
        own, now = b"%d" % rng.randrange(20_000), (k % 7 - 3, rng.randrange(-5, 5), k, -k)
        old = found.get(own)
        found[own] = min(now, old or now)
        assert best.take(own, now) == (max(now, old) if old else None)
        assert best.take(own, found[own]) is None  # the row is there twice
    batches = list(best.flushed())
    assert len(best) == 0 and max(b.num_rows for b in batches) == repeats.HANDED
    got = {r["segment"]: (r["doc_id"], r["part"], r["begin"], r["anchor"]) for b in batches for r in b.to_pylist()}
    assert got == found and sum(b.num_rows for b in batches) == len(found)


def test_the_transform_decides():
    phrases = phrases_of(1)
    index = repeats.RunIndex(phrases, 100)
    heads = np.random.default_rng(0).permutation(index.heads)
    index.keys = np.sort(heads * (index.rows + 1) + index.keys % (index.rows + 1))
    assert streamed(index, phrases) != repeats_by_search(phrases)


def made_documents(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "s1" if good == (rng.random() < 0.8) else "s2"))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return docs, labels, lambda i: "|" not in docs[i][1]


def test_co_training_on_held_out_documents(spark, docs_of):
    rows, labels, good = made_documents(500, 1)
    table = spark.createDataFrame(labels + [(0, 1 - labels[0][1], 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    got = quality.classify(docs, table).collect()
    assert len(got) == 500 and sum(r.keep == good(r.doc_id) for r in got if r.doc_id % 2) / 250 > 0.97
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))
    model = quality.fit(quality.featured(docs), table)
    assert all(sum(way) > 0 for way in zip(*model.exchanged, strict=True)) and model.held_out > 0.95
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns and 250 < kept.count() < 450


def test_without_usable_labels_all_stay(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None), (2, None), (3, "x" * 300_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one_class):
        assert [r.keep for r in quality.classify(docs, labels).collect()] == [True] * 4
    assert quality.classify(docs_of([]), none).count() == 0


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n\n", "x", "é" * 1000, "\ud800"):
        x = quality.text_features(text)
        assert np.isfinite(x).all() and len(x) == len(quality.text_features("plain text."))
    assert np.isfinite(quality.metadata_features(None, None, None)).all()


def test_sums_of_a_round_against_rows_one_by_one(spark, docs_of):
    rows, labels, _ = made_documents(240, 5)
    x = quality.featured(docs_of(rows, parts=5))
    full = x.collect()
    views = [np.array([np.frombuffer(bytes(r.text_x), "float32") for r in full], float), np.array([quality._from_slots(np.frombuffer(bytes(r.meta_x), np.uint16)[None])[0] for r in full])]
    y = np.array(["|" not in rows[r.doc_id][1] for r in full], float)
    models = [quality.Logistic(standard=k == 0).fit(v, y, np.ones(len(y))).calibrate(v, y) for k, v in enumerate(views)]
    histories = [[quality.Teacher(models[0], 1.0, -9.0)], [quality.Teacher(models[1], 2.0, -2.0), quality.Teacher(models[1], 0.5, -0.5)]]
    sums = quality.Pool(x).total(quality.pool_sums, models, histories)
    bins = quality.Pool(x).total(quality.pool_bins, models, histories)
    for k, model in enumerate(models):
        n, loss, gradient, left = 0, 0.0, 0.0, 0
        for i in range(len(y)):
            odds = [m.log_odds(v[i : i + 1])[0] for m, v in zip(models, views, strict=True)]
            left += not any(t.low < 0 and (odds[k] >= t.high or odds[k] <= t.low) for t in histories[k])
            taught = [t for t in histories[1 - k] if odds[1 - k] >= t.high or odds[1 - k] <= t.low]
            if taught:
                target = 1 / (1 + np.exp(-odds[1 - k]))
                own = np.append(np.clip((views[k][i] - model.mean) / model.scale, -8, 8), 1)
                z = float(own @ model.weights)
                n, loss, gradient = n + 1, loss + np.log1p(np.exp(z)) - target * z, gradient + own * (target - 1 / (1 + np.exp(-z)))
        assert sums[k][0] == n > 0 and abs(sums[k][1] - loss) < 1e-6 and np.allclose(sums[k][2 : 2 + len(gradient)], gradient)
        assert bins[k].sum() == left


def test_a_view_hands_over_its_surest_rows():
    bins = np.zeros(quality.BINS)
    bins[[100, 400, 420, 700]] = [1, 50, 48, 1]
    teacher = quality._teacher(quality.Logistic(), bins, 0.0, 0.97, 0.01)
    odds = np.array([-15.0, 0.01, 1.02, 15.0])
    assert teacher.picks(odds).tolist() == [True, False, False, True]
    # where all rows look alike none is handed over
    bins[:] = 0
    bins[400] = 10
    assert not quality._teacher(quality.Logistic(), bins, 0.0, 0.97, 0.01).picks(np.array([0.0, 0.04])).any()
