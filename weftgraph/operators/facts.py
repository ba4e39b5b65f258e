"""Extraction of facts: a pluggable extractor, one call for equal chunks, and validation of what it returns."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key, strip
from .shared import cut

MIN_ARITY, MAX_ARITY = 2, 6
RETRIES, DELAY = 2, 1.0
#: Why a fact is refused, in the order of the checks.
REASONS = (
    "not_a_dict", "bad_entity_list", "too_few_entities", "too_many_entities", "blank_entity", "bad_relation",
    "placeholder_relation", "bad_sentence_index", "index_out_of_range", "bad_confidence",
)
#: Shape of a response, for backends that can be held to one.
FACT_SCHEMA = {
    "type": "array",
    "items": {
        "type": "object",
        "properties": {
            "entities": {"type": "array", "items": {"type": "string"}, "minItems": MIN_ARITY, "maxItems": MAX_ARITY},
            "relation": {"type": "string"},
            "sentence_index": {"type": "integer", "minimum": 0},
            "confidence": {"type": "number", "minimum": 0, "maximum": 1},
        },
        "required": ["entities", "relation", "sentence_index", "confidence"],
        "additionalProperties": False,
    },
}
ENTITY_SCHEMA = {"type": "array", "items": {"type": "string"}}


class Extractor(Protocol):
    """Text in, raw response out. Runs inside the Python workers."""

    def facts(self, sentences: list[str]) -> str | None: ...

    def targeted(self, sentences: list[str], src: str, dst: str, goal: str) -> str | None: ...

    def question_entities(self, question: str) -> str | None: ...

    def is_available(self) -> bool: ...


class RuleExtractor:
    """Capitalised spans as entities, the first lower-case word between two as their relation. Deterministic, offline."""

    _SPAN = re.compile(r"[^\W\d_a-z][\w'-]*(?:\s+[^\W\d_a-z][\w'-]*)*")

    def _found(self, sentence: str) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), m[0]) for m in self._SPAN.finditer(sentence) if m[0][0].isupper()]

    def facts(self, sentences: list[str]) -> str | None:
        out = []
        for i, sentence in enumerate(sentences):
            spans = self._found(sentence)[:MAX_ARITY]
            if len({s.lower() for _, _, s in spans}) < MIN_ARITY:
                continue
            between = re.search(r"\b[a-z]\w*", sentence[spans[0][1] : spans[1][0]])
            out.append({
                "entities": [s for _, _, s in spans], "relation": between[0] if between else "related_to",
                "sentence_index": i, "confidence": 1.0,
            })
        return json.dumps(out)

    def targeted(self, sentences: list[str], src: str, dst: str, goal: str) -> str | None:
        wanted = (src.lower(), dst.lower())
        near = [f for f in json.loads(self.facts(sentences)) if any(w and w in e.lower() for w in wanted for e in f["entities"])]
        return json.dumps(near)

    def question_entities(self, question: str) -> str | None:
        return json.dumps([s for _, _, s in self._found(question)])

    def is_available(self) -> bool:
        return True


def _retried(call: Callable[[], str | None], retries: int, delay: float) -> str | None:
    for attempt in range(retries + 1):
        try:
            if (got := call()) is not None:
                return got
        except Exception:  # a backend may fail in any way; a failure is a missing response
            pass
        if attempt < retries:
            time.sleep(delay)
    return None


def extract(chunks: DataFrame, extractor: Extractor, retries: int = RETRIES, delay: float = DELAY) -> DataFrame:
    """(content_key, raw) for chunks with `sentences`, checkpointed: chunks of equal content are asked once.

    A missing response is null. Keys are spread over the tasks first, so a text
    that many chunks repeat costs one call and one row.
    """
    if not extractor.is_available():
        raise RuntimeError("the extractor is not available")
    keyed = chunks.select(content_key(F.col("sentences")).alias("content_key"), "sentences").dropDuplicates(["content_key"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [_retried(lambda s=s: extractor.facts(list(s)), retries, delay) for s in pdf["sentences"]]
            yield pd.DataFrame({"content_key": pdf["content_key"], "raw": pd.Series(raw, dtype=object, index=pdf.index)})

    return cut(keyed.mapInPandas(ask, "content_key string, raw string"))


def extract_targeted(asks: DataFrame, extractor: Extractor, retries: int = RETRIES, delay: float = DELAY) -> DataFrame:
    """`asks` (ask_id, sentences, src, dst, goal) with the raw response of each; checkpointed."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [
                _retried(lambda r=r: extractor.targeted(list(r.sentences), r.src, r.dst, r.goal or ""), retries, delay)
                for r in pdf.itertuples()
            ]
            yield pd.DataFrame({"ask_id": pdf["ask_id"], "raw": pd.Series(raw, dtype=object, index=pdf.index)})

    kind = dict(asks.dtypes)["ask_id"]
    return cut(asks.select("ask_id", "sentences", "src", "dst", "goal").mapInPandas(ask, f"ask_id {kind}, raw string"))


def question_entities(samples: DataFrame, extractor: Extractor, known: DataFrame | None = None) -> DataFrame:
    """(graph_id, entities) of (graph_id, question) rows, blanks dropped; those already in `known` aren't asked again."""
    new = samples.select("graph_id", "question") if known is None else samples.select("graph_id", "question").join(known, "graph_id", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [_retried(lambda q=q: extractor.question_entities(q or ""), 0, 0) for q in pdf["question"]]
            yield pd.DataFrame({"graph_id": pdf["graph_id"], "raw": pd.Series(raw, dtype=object, index=pdf.index)})

    got = new.mapInPandas(ask, f"graph_id {dict(samples.dtypes)['graph_id']}, raw string")
    listed = F.from_json(unwrapped(F.col("raw")), "array<string>")
    own = F.filter(F.transform(listed, strip), lambda e: e.isNotNull() & (e != ""))
    fresh = got.select("graph_id", F.coalesce(own, F.array().cast("array<string>")).alias("entities"))
    return fresh if known is None else known.select("graph_id", "entities").unionByName(fresh)


def unwrapped(raw: Column) -> Column:
    """A response without what stands around its JSON: what precedes </think>, a fenced block, its language name."""
    after = F.when(F.contains(raw, F.lit("<think>")), F.element_at(F.split(raw, "</think>"), -1)).otherwise(raw)
    fenced = F.when(F.contains(after, F.lit("```")), F.regexp_replace(F.get(F.split(after, "```"), 1), "^json", "")).otherwise(after)
    return strip(fenced)


def _is_text(col: Column) -> Column:
    return F.schema_of_variant(col) == "STRING"


def reason(fact: Column, sentences: Column, min_arity: int = MIN_ARITY, max_arity: int = MAX_ARITY) -> Column:
    """Why a VARIANT isn't a fact about these sentences: the first failing check, null for a valid one."""
    at = lambda path: F.try_variant_get(fact, path, "variant")
    kind = lambda col: F.coalesce(F.schema_of_variant(col), F.lit("VOID"))
    entities, relation, index, sure = (at(f"$.{k}") for k in ("entities", "relation", "sentence_index", "confidence"))
    listed = F.try_variant_get(fact, "$.entities", "array<variant>")
    n = F.size(listed)
    blank = F.exists(listed, lambda e: ~F.coalesce(_is_text(e), F.lit(False)) | (F.coalesce(strip(F.try_variant_get(e, "$", "string")), F.lit("")) == ""))
    name = strip(F.try_variant_get(fact, "$.relation", "string"))
    place = F.try_variant_get(fact, "$.sentence_index", "long")
    value = F.try_variant_get(fact, "$.confidence", "double")
    number = kind(sure).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(~F.startswith(kind(fact), F.lit("OBJECT")), "not_a_dict")
        .when(~F.startswith(kind(entities), F.lit("ARRAY")), "bad_entity_list")
        .when(n < min_arity, "too_few_entities")
        .when(n > max_arity, "too_many_entities")
        .when(blank, "blank_entity")
        .when((kind(relation) != "STRING") | (F.coalesce(name, F.lit("")) == ""), "bad_relation")
        .when(F.startswith(name, F.lit("<")), "placeholder_relation")
        .when(kind(index) != "BIGINT", "bad_sentence_index")
        .when((place < 0) | (place >= F.size(sentences)), "index_out_of_range")
        .when(~number | value.isNull() | (value < 0) | (value > 1), "bad_confidence")
    )


def checked_facts(responses: DataFrame) -> DataFrame:
    """A row for each fact, or failure, in (chunk_id, raw, sentences) rows.

    (chunk_id, fact_pos, fact, reason, parse_failed): parse_failed marks missing
    or unreadable responses; a response that isn't a list is one `not_a_dict`.
    """
    parsed = responses.withColumn("v", F.try_parse_json(unwrapped(F.col("raw"))))
    is_list = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    items = F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    failed = parsed.filter("v is null").select("chunk_id", F.lit(None).cast("int").alias("fact_pos"), F.lit(None).cast("variant").alias("fact"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("parse_failed"))
    each = parsed.filter("v is not null").select("chunk_id", "sentences", is_list.alias("is_list"), F.posexplode(items).alias("fact_pos", "fact"))
    why = F.when(~F.col("is_list"), F.lit("not_a_dict")).otherwise(reason(F.col("fact"), F.col("sentences")))
    return each.select("chunk_id", "fact_pos", "fact", why.alias("reason"), F.lit(False).alias("parse_failed")).unionByName(failed)


def facts_from(checked: DataFrame) -> DataFrame:
    """Typed columns of the valid facts: chunk_id, fact_pos, raw_entities, relation, sentence_index, confidence."""
    get = lambda path, kind: F.try_variant_get("fact", path, kind)
    return checked.filter("not parse_failed and reason is null").select(
        "chunk_id", "fact_pos", get("$.entities", "array<string>").alias("raw_entities"), get("$.relation", "string").alias("relation"),
        get("$.sentence_index", "int").alias("sentence_index"), get("$.confidence", "double").alias("confidence"),
    )


def with_content(chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """Chunks with the response to their content, and whether they are the first of it (who answers for a failure)."""
    keyed = chunks.withColumn("content_key", content_key(F.col("sentences")))
    first = keyed.groupBy("content_key").agg(F.min(F.struct("graph_id", "chunk_idx")).alias("first"))
    joined = keyed.join(extracted, "content_key", "left").join(first, "content_key")
    return joined.withColumn("asked", F.struct("graph_id", "chunk_idx") == F.col("first")).drop("first")


def parse_failures(checked: DataFrame, asked: DataFrame) -> DataFrame:
    """(graph_id, parse_failures) for all graphs of `asked` (graph_id, chunk_id, asked)."""
    failed = checked.filter("parse_failed").select("chunk_id").distinct().withColumn("failed", F.lit(1))
    own = asked.select("graph_id", "chunk_id", "asked").join(failed, "chunk_id", "left")
    return own.groupBy("graph_id").agg(F.count_if(F.col("asked") & F.col("failed").isNotNull()).alias("parse_failures"))


def extractor_stats(checked: DataFrame) -> DataFrame:
    """(measure, n): responses, parse failures, valid facts, and refusals by reason."""
    measure = F.when(F.col("parse_failed"), "parse_failures").when(F.col("reason").isNull(), "valid").otherwise(F.concat(F.lit("rejected:"), "reason"))
    return checked.groupBy(measure.alias("measure")).agg(F.count("*").alias("n"))
