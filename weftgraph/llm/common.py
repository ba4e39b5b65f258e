"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows up to which a keyed side may be broadcast. Keys are a few dozen bytes, so
#: this bounds the broadcast at some tens of MB; above it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share.

    A private one is made only on a single machine where that is unset; on a
    cluster executors couldn't read it, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """`df`, a checkpoint, in no more partitions than one for each `rows` of its rows."""
    return df.coalesce(df.count() // rows + 1)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else unchanged.

    `df` should be cheap to count (a checkpoint or a small aggregate).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(col, UPPER, LOWER)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
