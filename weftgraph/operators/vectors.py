"""Vectors: a deterministic encoder and exact nearest neighbours by cosine."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

DIMENSIONS = 256
TOP_K, MIN_SIMILARITY = 3, 0.72
#: Queries that a task multiplies with a batch of items at once.
QUERY_BLOCK = 256


def hashing_encoder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of hashed words and letter triples: a stand-in for a language model where none is at hand."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = (text or "").lower().split()
        for part in [*words, *(w[i : i + 3] for w in words for i in range(len(w) - 2))]:
            code = zlib.crc32(part.encode("utf-8", "surrogatepass"))
            row[code % dimensions] += 1 if code & 0x80000000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def encode(texts: Column, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder) -> Column:
    """Array of floats for each text. A loaded model belongs in `encoder`, which lives as long as the Python worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(encoder([t or "" for t in batch])), index=batch.index)

    return run(texts)


def cosine(a: Column, b: Column) -> Column:
    """Dot product, which is the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, items: DataFrame, k: int = TOP_K, min_similarity: float = MIN_SIMILARITY, on: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(on.., query, item, sim, rank): the k most similar items of each query, then those under the limit dropped.

    queries: (on.., query, vector), items: (on.., item, vector). Ties go to the
    smaller item. With `on`, a query sees its own graph's items; graphs are
    small. Without, every query sees every item: see `top_k_blocks`.
    """
    if not on:
        return top_k_blocks(queries, items, k, min_similarity)
    joined = queries.withColumnRenamed("vector", "v").join(items.withColumnRenamed("vector", "w"), list(on))
    scored = joined.select(*on, "query", "item", cosine(F.col("v"), F.col("w")).alias("sim"))
    best = Window.partitionBy(*on, "query").orderBy(F.col("sim").desc(), "item")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).filter(F.col("sim") >= min_similarity)


def top_k_blocks(queries: DataFrame, items: DataFrame, k: int, min_similarity: float, max_queries: int = 100_000) -> DataFrame:
    """(query, item, sim, rank) of a stated query set against all items, in blocks.

    The sorted queries are taken in sets of at most `max_queries` rows. A set's
    matrix is shipped to the tasks; a task multiplies it with its items block by
    block and hands on its best k for each query, so k rows a query and task are
    shuffled, however many items there are. With more than one set, what each
    found is checkpointed before the next is shipped.
    """
    rows = queries.select("query", "vector").orderBy("query").toLocalIterator()
    found = None
    while (own := list(itertools.islice(rows, max_queries))) or found is None:
        best, shared = _searched(own, items, k, dict(queries.dtypes)["query"])
        if found is None and len(own) < max_queries:
            return _best(best, k).filter(F.col("sim") >= min_similarity)
        best = cut(_best(best, k).drop("rank"))
        shared.unpersist()
        found = best if found is None else found.unionByName(best)
    # a query that is there several times may be in two sets
    return _best(found, k).filter(F.col("sim") >= min_similarity)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(rows: list, items: DataFrame, k: int, kind: str) -> tuple[DataFrame, Broadcast]:
    """(query, item, sim): the best k items of each task for each of these queries; and the broadcast it reads."""
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))
    shared = items.sparkSession.sparkContext.broadcast((names, matrix))
    item_kind = dict(items.dtypes)["item"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        starts = range(0, len(names), QUERY_BLOCK)
        kept = {at: (np.empty((len(names[at : at + QUERY_BLOCK]), 0)), np.empty((len(names[at : at + QUERY_BLOCK]), 0), object)) for at in starts}
        for pdf in batches:
            if not len(pdf):
                continue
            vectors, own_ids = np.array(pdf["vector"].tolist(), np.float64).T, pdf["item"].to_numpy(object)
            for at, (sims, ids) in kept.items():
                sims = np.hstack([sims, matrix[at : at + QUERY_BLOCK] @ vectors])
                ids = np.hstack([ids, np.tile(own_ids, (len(sims), 1))])
                # best first, then the smaller item: sort by item, then stably by falling similarity
                by_id = np.argsort(ids, axis=1, kind="stable")
                sims, ids = np.take_along_axis(sims, by_id, 1), np.take_along_axis(ids, by_id, 1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                kept[at] = np.take_along_axis(sims, best, 1), np.take_along_axis(ids, best, 1)
        for at, (sims, ids) in kept.items():
            if sims.size:
                own = np.array(names[at : at + QUERY_BLOCK], object)
                yield pd.DataFrame({"query": np.repeat(own, sims.shape[1]), "item": ids.ravel(), "sim": sims.ravel()})

    return items.select("item", "vector").mapInPandas(search, f"query {kind}, item {item_kind}, sim double"), shared
