"""Token counts from an exact length histogram.

Each task encodes its rows and keeps only a count of rows by encoded length;
the counts are summed by length. Suffix sums over the histogram, first by
blocks of lengths and then inside a block, answer totals, quantiles and
truncated totals for every context limit, without another look at a text.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, if_small, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 256


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text: str | None, path: str = VOCABULARY, pattern: str = PATTERN) -> int:
    return len(encoding(path, pattern).encode_ordinary(text)) if text else 0


def length_histogram(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many rows of `docs` encode to so many tokens.

    `path` is a file of token ranks that every executor can open. Null and empty
    texts have 0 tokens; repeated rows all count. Only text is read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                own[encoded_length(text.as_py(), path, pattern)] += 1
        yield pa.RecordBatch.from_pydict(
            {"n_tokens": pa.array(own.keys(), pa.int64()), "n_docs": pa.array(own.values(), pa.int64())}
        )

    counted = docs.select("text").mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """A row for each length that occurs, taken as a context limit:

    n_tokens, n_docs; docs_over and tokens_over: rows at least so long and their
    tokens; docs_total, tokens_total: of all rows; tokens_truncated: tokens left
    when every row is cut at this length; docs_share: the part of all rows not
    longer, so the q-quantile is the least length with docs_share >= q.
    An empty histogram gives no rows.
    """
    hist = cut(histogram.withColumn("block", F.expr(f"n_tokens div {BLOCK}")))
    tokens = F.col("n_tokens") * F.col("n_docs")
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    blocks = blocks.select(
        F.col("block").alias("of"),
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(total).alias("docs_total"),
        F.sum("tokens").over(total).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = hist.join(if_small(blocks), F.col("block") == F.col("of"))
    out = out.withColumn("docs_over", F.sum("n_docs").over(inside) + F.col("docs_after"))
    out = out.withColumn("tokens_over", F.sum(tokens).over(inside) + F.col("tokens_after"))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("tokens_truncated"),
        ((F.col("docs_total") - F.col("docs_over") + F.col("n_docs")) / F.col("docs_total")).alias("docs_share"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens): all tokens when every row is cut at `limit`, for any limits, occurring or not."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "limit long")
    at = sums.select("n_tokens", "docs_over", "tokens_over", "tokens_total")
    first = asked.join(F.broadcast(at.agg(F.max("tokens_total").alias("everything"))), how="left")
    # the rows over a limit are those of the least length above it
    over = asked.join(at, F.col("n_tokens") > F.col("limit")).groupBy("limit").agg(
        F.min(F.struct("n_tokens", "docs_over", "tokens_over")).alias("next")
    )
    tokens = F.col("everything") - F.coalesce("next.tokens_over", F.lit(0)) + F.col("limit") * F.coalesce("next.docs_over", F.lit(0))
    return first.join(over, "limit", "left").select("limit", F.coalesce(tokens, F.lit(0)).alias("tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that so large a share of the rows doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(sums, F.col("docs_share") >= F.col("share"), "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
