"""Quality classifier by co-training.

Two logistic classifiers see one document each in their own way: the text view
has statistics of the whole text, the metadata view has the columns beside it.
In each round every view is fitted and calibrated on labelled rows kept apart,
and judges all unlabelled rows; those it is sure of, and in any case the `share`
it is surest of in each class, go with their calibrated chance as pseudo-label
into the other view's training rows. At the end a small logistic model over the
two calibrated log odds, fitted on a fold of its own, scores every document.

A bounded sample of labelled rows (`labelled_rows`, those of least hashed
doc_id) is on the driver. Unlabelled rows never are: their features are
checkpointed, and a Newton step takes sums of gradients and curvatures over all
of them from the executors. Which rows a view was given follows from the models
of the rounds before, so no row has state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import cut, if_small, table

#: Character classes: 0 white space, 1 line end, 2 upper, 3 lower, 4 digit, 5 beyond ASCII, 6 other.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
#: ASCII signs with a share of their own.
_SIGNS = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
#: Slots of the metadata view: language, source, both, and length by powers of two, negative or unknown last.
_SLOTS = (32, 64, 128, 18)
META_WIDTH = sum(_SLOTS)
#: Bins of log odds from -20 to 20, and tasks that add up the executors' sums.
BINS, ADDERS = 800, 8
METADATA = ("lang", "source", "n_chars")


def text_features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; all finite for null and empty ones."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    size = max(1, len(raw))
    kinds = _CLASS[raw]
    shares = np.bincount(kinds, minlength=7) / size
    signs = np.bincount(raw, minlength=256)[_SIGNS] / size
    turns = kinds[np.flatnonzero(np.diff(kinds, prepend=255))].astype(np.int64)
    pairs = np.bincount(turns[:-1] * 7 + turns[1:], minlength=49) / max(1, len(turns) - 1)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n, kinds_of = max(1, len(words)), len(set(words))
    more = [
        len(raw) / n / 10,
        kinds_of / n,
        np.log1p(kinds_of) / np.log1p(n),
        len(set(lines)) / max(1, len(lines)),
        len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2),  # noqa: B905
        np.log1p(len(lines)) / np.log1p(n),
        max(map(len, words), default=0) / 100,
        float(not words),
    ]
    more[6] = min(more[6], 10.0)
    return np.concatenate([shares, np.sqrt(signs), pairs, more])


def metadata_slots(lang, source, n_chars) -> np.ndarray:
    """Which slots are set, one of each kind."""
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    own = [
        xxh32_intdigest(f"lang={lang}") % _SLOTS[0],
        xxh32_intdigest(f"source={source}") % _SLOTS[1],
        xxh32_intdigest(f"lang={lang},source={source}") % _SLOTS[2],
        min(16, int(np.log2(1 + float(n_chars)))) if known else 17,
    ]
    return (np.cumsum([0, *_SLOTS[:-1]]) + own).astype(np.uint16)


def _from_slots(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), META_WIDTH))
    np.put_along_axis(out, slots.astype(np.int64), 1.0, 1)
    return out


def metadata_features(lang, source, n_chars) -> np.ndarray:
    return _from_slots(metadata_slots(lang, source, n_chars)[None])[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton(design: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights of least penalised log loss; targets may lie between 0 and 1. A step that makes it worse is halved."""

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(weight @ (np.logaddexp(0, z) - target * z) + 0.5 * ridge @ (w * w))

    w = np.zeros(design.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(design @ w)
        gradient = design.T @ (weight * (target - p)) - ridge * w
        curve = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(ridge)
        move = np.linalg.solve(curve, gradient)
        while (then := loss(w + move)) > now and np.abs(move).max() > 1e-7:
            move = move / 2
        if then > now:
            break
        w, gain, now = w + move, now - then, then
        if gain < 1e-7 * (1 + abs(now)):
            break
    return w


@dataclass
class Logistic:
    """L2-regularised logistic regression, on standardised features unless told otherwise, with Platt calibration."""

    l2: float = 1.0
    standard: bool = True
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if self.standard else (0.0, 1.0)
        design = self._design(x)
        self.weights = _newton(design, y, weight, self.ridge(design.shape[1]))
        return self

    def ridge(self, width: int) -> np.ndarray:
        out = np.full(width, self.l2)
        out[-1] = 1e-6
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        raw = self._design(x) @ self.weights
        size = raw.std() + 1e-6
        # targets drawn in from 0 and 1, as Platt does, keep the fit finite
        target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        design = np.column_stack([raw / size, np.ones(len(raw))])
        slope, offset = _newton(design, target, np.ones(len(raw)), np.array([1e-3, 1e-6]))
        self.slope, self.offset = float(max(slope, 0.0) / size), float(offset)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (self._design(x) @ self.weights) + self.offset, -20, 20)


@dataclass
class Teacher:
    """A view as it was in one round, and the log odds from which, or down to which, it is sure."""

    model: Logistic
    high: float
    low: float

    def picks(self, odds: np.ndarray) -> np.ndarray:
        return (odds >= self.high) | (odds <= self.low)


def given(history: list[Teacher], x: np.ndarray) -> np.ndarray:
    """Pseudo-labels that the other view's teachers gave rows, each once; NaN where none did."""
    out = np.full(len(x), np.nan)
    for teacher in history:
        odds = teacher.model.log_odds(x)
        own = np.isnan(out) & teacher.picks(odds)
        out[own] = _sigmoid(odds[own])
    return out


def pool_sums(views: list[np.ndarray], models: list[Logistic], histories: list[list[Teacher]]) -> list[np.ndarray]:
    """For each view: rows given to it, and their loss, gradient and curvature at the view's weights."""
    out = []
    for k, model in enumerate(models):
        labels = given(histories[1 - k], views[1 - k])
        got = ~np.isnan(labels)
        design, target = model._design(views[k][got]), labels[got]
        z = design @ model.weights
        p = _sigmoid(z)
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design
        loss = float((np.logaddexp(0, z) - target * z).sum())
        out.append(np.concatenate([[got.sum(), loss], design.T @ (target - p), curve.reshape(-1)]))
    return out


def pool_bins(views: list[np.ndarray], models: list[Logistic], histories: list[list[Teacher]]) -> list[np.ndarray]:
    """For each view: its rows by log odds, of those it hasn't given a label yet."""
    out = []
    for k, model in enumerate(models):
        odds = model.log_odds(views[k][np.isnan(given(histories[k], views[k]))])
        out.append(np.bincount(((odds + 20) * (BINS / 40)).astype(np.int64).clip(0, BINS - 1), minlength=BINS).astype(float))
    return out


class Pool:
    """All unlabelled rows: their features stay with the executors, which return sums."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("text_x", "meta_x")

    def total(self, kind, models: list[Logistic], histories: list[list[Teacher]]) -> list[np.ndarray] | None:
        """Sums of `kind` (pool_sums or pool_bins) over all rows, for both views; None without rows."""
        job = pickle.dumps((models, histories))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, histories = pickle.loads(job)
            sums, first = None, 0
            for batch in batches:
                if batch.num_rows:
                    text, meta = (batch.column(k).to_pylist() for k in (0, 1))
                    first = first or xxh32_intdigest(text[0] + meta[0])
                    got = kind([_matrix(text), _slots(meta)], models, histories)
                    sums = got if sums is None else [x + y for x, y in zip(sums, got, strict=True)]
            if sums is not None:
                yield _packed(first % ADDERS, sums)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    got = [np.frombuffer(x) for x in blobs]
                    sums = got if sums is None else [x + y for x, y in zip(sums, got, strict=True)]
            if sums is not None:
                yield _packed(0, sums)

        schema = "adder int, text binary, meta binary"
        parts = self.rows.mapInArrow(own, schema).repartition(ADDERS, "adder").mapInArrow(add, schema).collect()
        return [sum(np.frombuffer(bytes(r[k])) for r in parts) for k in (1, 2)] if parts else None


def _packed(adder: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    own = [pa.array([adder], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)]
    return pa.RecordBatch.from_arrays(own, names=["adder", "text", "meta"])


@dataclass
class CoTrained:
    """Both calibrated views and their combination. Without views (too few labels) everything scores `prior`.

    exchanged: per round, rows that the text view gave the metadata view, and the other way round.
    """

    text: Logistic | None = None
    meta: Logistic | None = None
    both: Logistic | None = None
    prior: float = 1.0
    threshold: float = 0.5
    exchanged: list[tuple[int, int]] = field(default_factory=list)
    held_out: float | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return tuple(np.full(len(text), self.prior) for _ in range(3))
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both.log_odds(np.column_stack([a, b])))


def _teacher(model: Logistic, bins: np.ndarray, base: float, sure: float, share: float) -> Teacher:
    """Sure from the chance `sure` on, or for the `share` of rows that lie highest and lowest, on their side of the base rate."""
    edges = np.linspace(-20, 20, BINS + 1)
    part = share * bins.sum()
    # whole bins: from the one in which the share is reached
    high = edges[BINS - 1 - int(np.searchsorted(np.cumsum(bins[::-1]), part))] if bins.sum() else np.inf
    low = edges[1 + int(np.searchsorted(np.cumsum(bins), part))] if bins.sum() else -np.inf
    odds = float(np.log(sure / (1 - sure)))
    return Teacher(model, max(min(odds, high), base + 0.1), min(max(-odds, low), base - 0.1))


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, pool: Pool,
    rounds: int = 3, steps: int = 4, sure: float = 0.97, share: float = 0.02, pseudo_weight: float = 0.5, threshold: float = 0.5,
) -> CoTrained:
    """fold: 0 train, 1 calibrate, 2 combine, 3 held out.

    A view gives each row one pseudo-label at most. All rows given to a view
    weigh at most `pseudo_weight` times its labelled ones, whatever their number.
    """
    train, tune, join, test = (fold == k for k in range(4))
    out = CoTrained(threshold=threshold)
    if min(len(set(y[train])), len(set(y[tune]))) < 2:
        return out
    if len(set(y[join])) < 2:
        join = tune
    views = [text, meta]
    models = [Logistic(standard=k == 0).fit(x[train], y[train], np.ones(train.sum())).calibrate(x[tune], y[tune]) for k, x in enumerate(views)]
    base = float(np.log(y[train].mean() / (1 - y[train].mean())))
    histories: list[list[Teacher]] = [[], []]
    before = np.zeros(2)
    for _ in range(rounds):
        bins = pool.total(pool_bins, models, histories)
        if bins is None:
            break
        histories = [[*h, _teacher(m, b, base, sure, share)] for h, m, b in zip(histories, models, bins, strict=True)]
        models, got = _refitted(models, views, y, train, pool, histories, steps, pseudo_weight)
        models = [m.calibrate(x[tune], y[tune]) for m, x in zip(models, views, strict=True)]
        # rows given to the metadata view come from the text view
        out.exchanged.append((int(got[1] - before[1]), int(got[0] - before[0])))
        before = got
    out.text, out.meta = models
    odds = np.column_stack([m.log_odds(x) for m, x in zip(models, views, strict=True)])
    out.both = Logistic(l2=0.1).fit(odds[join], y[join], np.ones(join.sum())).calibrate(odds[join], y[join])
    if test.any():
        right = _sigmoid(out.both.log_odds(odds[test])) >= threshold
        out.held_out = float((right == (y[test] > 0.5)).mean())
    return out


def _refitted(models, views, y, train, pool, histories, steps, pseudo_weight) -> tuple[list[Logistic], np.ndarray]:
    """Newton steps for both views over labelled rows and pool sums; a step that made it worse is halved. Also the rows given."""
    models = [Logistic(**vars(m)) for m in models]
    designs = [m._design(x[train]) for m, x in zip(models, views, strict=True)]
    ridges = [m.ridge(d.shape[1]) for m, d in zip(models, designs, strict=True)]
    target = y[train]
    best = [(np.inf, m.weights, np.zeros_like(m.weights)) for m in models]  # loss, weights and the move from there
    got = np.zeros(2)
    for step in range(steps + 1):
        sums = pool.total(pool_sums, models, histories)
        for k, (m, design, ridge, own) in enumerate(zip(models, designs, ridges, sums, strict=True)):
            n, width = own[0], design.shape[1]
            got[k] = n
            weight = pseudo_weight * min(1.0, len(target) / n) if n else 0.0
            z, w = design @ m.weights, m.weights
            p = _sigmoid(z)
            loss = float((np.logaddexp(0, z) - target * z).sum() + 0.5 * ridge @ (w * w) + weight * own[1])
            if loss <= best[k][0]:
                gradient = design.T @ (target - p) - ridge * w + weight * own[2 : 2 + width]
                curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(ridge) + weight * own[2 + width :].reshape(width, width)
                best[k] = loss, w, np.linalg.solve(curve, gradient)
            else:
                best[k] = *best[k][:2], best[k][2] / 2
            m.weights = best[k][1] + best[k][2] if step < steps else best[k][1]
    return models, got


def _features(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(x) for x in pdf["text"]])
    meta = np.array([metadata_features(*x) for x in zip(*(pdf[c] for c in METADATA), strict=True)])
    return text, meta


def _by_hash(ids: DataFrame, rows: int) -> DataFrame:
    return ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, text_x, meta_x) of every row, checkpointed."""

    def of(batches):
        for pdf in batches:
            text = [text_features(x).astype("float32").tobytes() for x in pdf["text"]]
            meta = [metadata_slots(*x).tobytes() for x in zip(*(pdf[c] for c in METADATA), strict=True)]
            yield pdf[["doc_id"]].assign(text_x=text, meta_x=meta)

    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return cut(rows.mapInPandas(of, f"doc_id {dict(docs.dtypes)['doc_id']}, text_x binary, meta_x binary"))


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, blobs)), "float32").astype(float).reshape(len(blobs), -1)


def _slots(blobs) -> np.ndarray:
    return _from_slots(np.frombuffer(b"".join(map(bytes, blobs)), np.uint16).reshape(len(blobs), -1))


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", labelled_rows: int = 6000, **more) -> CoTrained:
    """Co-trained views for `rows` (see `featured`), from `labels` (doc_id, label of 0 or 1).

    Null labels and ids, and ids with contradictory labels, are left out; rows
    without an agreed label, repeated or without an id, are all unlabelled ones.
    Only the labelled sample is bounded, by `labelled_rows` in the order of
    md5(doc_id); of rows that share a labelled id, the least by features is taken.
    """
    agreed = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z"))
    agreed = cut(agreed.filter("y = z").select("doc_id", "y"))
    some = cut(_by_hash(agreed.join(rows.select("doc_id"), "doc_id", "left_semi"), labelled_rows))
    own = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text_x", "meta_x")).alias("x"))
    own = own.select("doc_id", "y", "x.*").toPandas().sort_values("doc_id")
    if not len(own):
        return CoTrained()
    pool = Pool(rows.join(if_small(agreed.select("doc_id")), "doc_id", "left_anti"))
    fold = np.array([xxh32_intdigest(f"fold={i}") % 6 for i in own["doc_id"]])
    fold = np.where(fold < 3, 0, fold - 2)
    return co_train(_matrix(own["text_x"].tolist()), _slots(own["meta_x"].tolist()), own["y"].to_numpy(float), fold, pool, **more)


def scored(docs: DataFrame, model: CoTrained, name: str = "quality"):
    """Column with text_score, meta_score, score and keep for each row of `docs`."""

    @F.pandas_udf("text_score double, meta_score double, score double, keep boolean")
    def judge(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        pdf = pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars})
        if not len(pdf):
            return pd.DataFrame({"text_score": [], "meta_score": [], "score": [], "keep": []})
        a, b, c = model.scores(*_features(pdf))
        return pd.DataFrame({"text_score": a, "meta_score": b, "score": c, "keep": c >= model.threshold})

    return judge(docs["text"], docs["lang"], docs["source"], docs["n_chars"].cast("double"))


def classify(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for each row of `docs`.

    Scores are calibrated chances of good quality; keep is score >= threshold.
    Null texts and metadata have features of their own. If the labels don't hold
    both classes nothing can be learned: every score is 1 and all rows stay.
    Repeated rows are scored alike; an empty table gives an empty result.
    """
    rows = featured(docs)
    model = fit(rows, labels, **more)

    def judge(batches):
        for pdf in batches:
            if len(pdf):
                a, b, c = model.scores(_matrix(pdf["text_x"].tolist()), _slots(pdf["meta_x"].tolist()))
                yield pdf[["doc_id"]].assign(text_score=a, meta_score=b, score=c, keep=c >= model.threshold)

    return rows.mapInPandas(judge, f"doc_id {dict(docs.dtypes)['doc_id']}, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """`docs`, all columns, without the rows the classifier rejects."""
    model = fit(featured(docs), labels, **more)
    return docs.filter(scored(docs, model)["keep"])


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
