"""Question rows, parameterised caches, and sinks for graphs, reports and records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators.chunking import CHUNK_SIZE, OVERLAP, articles, check_window, samples, sentence_chunks

RAW_SCHEMA = (
    "id string, question string, answer string, type string, level string, "
    "supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>"
)
CHAIN_TERMINALS = "array<struct<status:string,is_trivial:boolean,is_genuine:boolean,is_connected:boolean>>"
REPORT_SCHEMA = (
    "sample_id string, hop_type string, failure_mode string, is_answerable boolean, is_clean boolean, is_repairable boolean, "
    f"question_entities array<string>, answer string, terminal array<string>, chain_terminals {CHAIN_TERMINALS}, trivial_terminal boolean, "
    "genuine_terminal boolean, text_grounded boolean, num_reasoning_chains long, total_broken_hops long, num_heals long, parse_failures long, "
    "supporting_titles array<string>"
)
#: Changes when the text of a cached table would.
TEXT_VERSION = 2


def read_questions(spark: SparkSession, path: str, max_samples: int | None = None, order: str = "id") -> DataFrame:
    """Raw question rows from JSON lines or Parquet; with `max_samples` the first so many in the order of `order`."""
    reader = spark.read.schema(RAW_SCHEMA)
    rows = reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")) else reader.parquet(path)
    return rows.orderBy(order).limit(max_samples) if max_samples else rows


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, base: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """`build()` as a Parquet table in a folder named by the parameters: others have another folder.

    A folder counts once its writer has finished; an unfinished one is overwritten.
    """
    key = hashlib.md5(json.dumps({**params, "text_version": TEXT_VERSION}, sort_keys=True).encode()).hexdigest()
    path = f"{base.rstrip('/')}/params={key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_chunks(
    spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, max_samples: int | None = None, cache: str | None = None, split: str = "validation"
) -> tuple[DataFrame, DataFrame]:
    """(samples, chunks) of a file of question rows; both cached under `cache` if given."""
    check_window(size, overlap)
    params = {"path": path, "split": split, "size": size, "overlap": overlap, "max_samples": max_samples or 0}
    own = samples(read_questions(spark, path, max_samples))
    if cache is None:
        return own, sentence_chunks(articles(own), size, overlap)
    own = cached(spark, f"{cache}/samples", params, lambda: own)
    return own, cached(spark, f"{cache}/chunks", params, lambda: sentence_chunks(articles(own), size, overlap))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables of a graph; a graph that is there already isn't overwritten."""
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    edges.write.mode("errorifexists").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graph_or_build(spark: SparkSession, path: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The graph saved at `path`, or else built, saved and read."""
    if not (_exists(spark, f"{path}/nodes/_SUCCESS") and _exists(spark, f"{path}/edges/_SUCCESS")):
        save_graph(*build(), path)
    return load_graph(spark, path)


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines: reports, facts to label, labels, repair attempts, scored answers."""
    rows.write.mode(mode).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)


def quarantine(checked: DataFrame, responses: DataFrame) -> DataFrame:
    """(file_name, chunk_id, raw): responses that couldn't be read, under names that any file system takes."""
    failed = checked.filter("parse_failed").select("chunk_id").distinct()
    return responses.join(failed, "chunk_id", "left_semi").select(file_name(F.col("chunk_id")).alias("file_name"), "chunk_id", "raw")
