"""Rollups and scores."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, normalize_answer, relation_tokens, sentence_tokens

STATUSES = ("entity_reached", "entity_unreached", "not_an_entity", "predicate")


def corpus_rollup(report_rows: DataFrame) -> DataFrame:
    """(measure, value): counts over reports, histograms of modes and terminal statuses, answerable out of clean ones."""
    ok = F.col("parse_failures") == 0
    flags = {
        "samples": F.lit(True), "answerable": F.col("is_answerable"), "clean": F.col("is_clean"), "repairable": F.col("is_repairable"),
        "trivial_terminal": F.col("trivial_terminal"), "genuine_terminal": F.col("genuine_terminal"), "text_grounded": F.col("text_grounded"),
        "with_parse_failures": ~ok, "without_parse_failures": ok, "answerable_without_parse_failures": ok & F.col("is_answerable"),
    }
    once = [F.when(on, F.lit(name)) for name, on in flags.items()]
    modes = F.concat(F.lit("mode:"), F.col("failure_mode"))
    statuses = F.transform("terminal", lambda s: F.concat(F.lit("status:"), s))
    each = report_rows.select(F.explode(F.array_compact(F.concat(F.array(*once, modes), statuses))).alias("measure"))
    return each.groupBy("measure").agg(F.count("*").alias("value"))


def arity_histogram(edges: DataFrame, distinct: bool = True) -> DataFrame:
    size = F.size(F.array_distinct("entities")) if distinct else F.size("entities")
    return edges.groupBy(size.alias("arity")).agg(F.count("*").alias("edges"))


def relation_histogram(edges: DataFrame, top: int = 15, order: str = "edge_seq") -> DataFrame:
    """The most frequent relations; of equally frequent ones those met first."""
    counted = edges.groupBy("relation").agg(F.count("*").alias("edges"), F.min(F.struct("graph_id", order)).alias("first"))
    return counted.orderBy(F.col("edges").desc(), "first").limit(top).select("relation", "edges")


def contamination(edges: DataFrame) -> DataFrame:
    """(graph_id, rate): share of a graph's edges whose relation has no token in their sentence, if it has tokens at all."""
    name, said = relation_tokens(F.col("relation")), sentence_tokens(F.coalesce("sentence", F.lit("")))
    missing = (F.size(name) > 0) & ~F.arrays_overlap(name, said)
    return edges.groupBy("graph_id").agg(F.avg(F.coalesce(missing, F.lit(False)).cast("int").cast("double")).alias("rate"))


def corpus_contamination(rates: DataFrame) -> DataFrame:
    return rates.agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias("mean_rate"), F.count("*").alias("graphs"))


def hop_types(report_rows: DataFrame) -> DataFrame:
    """(hop_type, n, percent)."""
    total = F.sum("n").over(Window.partitionBy())
    return report_rows.groupBy("hop_type").agg(F.count("*").alias("n")).withColumn("percent", F.bround(100 * F.col("n") / total, 1))


def terminal_buckets(end: Column) -> Column:
    """Labels under which one chain's terminal is counted."""
    status, real, plain = end["status"], end["is_genuine"], end["is_trivial"]
    apart = (status == "entity_reached") & ~end["is_connected"]
    fine = (
        F.when((status == "entity_reached") & real, "genuine+reached").when((status == "entity_reached") & plain, "trivial+reached")
        .when((status == "entity_unreached") & plain, "trivial+unreached").when(status == "entity_unreached", "genuine-attempt+unreached")
    )
    lost = F.array(F.lit("reached_but_disconnected"), F.when(real, F.lit("reached_but_disconnected_genuine")))
    return F.array_compact(F.when(apart, lost).otherwise(F.array(status, fine)))


def terminal_crosstab(report_rows: DataFrame) -> DataFrame:
    """(kind, label, n): buckets of terminals for bridge and other samples, and pairs of statuses for the latter.

    Only the first chain of a bridge and the first two of a comparison count;
    comparisons with fewer are counted as `short`.
    """
    kind = F.when(F.col("hop_type") == "bridge", "bridge").otherwise("comparison")
    ends, n = F.col("chain_terminals"), F.size("chain_terminals")
    first, second = F.get(ends, 0), F.get(ends, 1)
    mark = lambda e: F.concat(e["status"], F.lit(" | G="), F.when(e["is_genuine"], "Y").otherwise("N"), F.lit(" T="), F.when(e["is_trivial"], "Y").otherwise("N"))
    two = F.concat(
        terminal_buckets(first), terminal_buckets(second),
        F.array(F.concat(first["status"], F.lit(" x "), second["status"]), F.concat(mark(first), F.lit(" <-> "), mark(second))),
    )
    short = F.array(F.lit("short"))
    labels = F.when(kind == "bridge", F.when(n > 0, terminal_buckets(first)).otherwise(short)).otherwise(F.when(n > 1, two).otherwise(short))
    return report_rows.select(kind.alias("kind"), F.explode(labels).alias("label")).groupBy("kind", "label").agg(F.count("*").alias("n"))


def grounded_not_connected(report_rows: DataFrame) -> DataFrame:
    return report_rows.agg(F.count_if(F.col("text_grounded") & (F.col("failure_mode") != "connected")).alias("n"))


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_answer(pred) == normalize_answer(gold)).cast("double")


def token_f1(pred: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall of tokens, repeats counted; without tokens 1 if neither has any."""

    @F.pandas_udf("int")
    def shared_of(p: pd.Series, g: pd.Series) -> pd.Series:  # linear in the length of the texts
        both = [None if x is None or y is None else sum((Counter(x) & Counter(y)).values()) for x, y in zip(p, g, strict=True)]
        return pd.Series(both, dtype="Int32")

    p, g = answer_tokens(pred), answer_tokens(gold)
    shared = shared_of(p, g)
    none = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(none, (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * shared / (F.size(p) + F.size(g)))


def scored_answers(answers: DataFrame) -> DataFrame:
    """Rows (.., pred, gold) with em and f1."""
    return answers.withColumn("em", exact_match(F.col("pred"), F.col("gold"))).withColumn("f1", token_f1(F.col("pred"), F.col("gold")))


def by_condition(scored: DataFrame, *more: str) -> DataFrame:
    """Mean em and f1 in per cent, and mean facts, by condition and further columns (answerable, failure_mode)."""
    return scored.groupBy("condition", *more).agg(
        F.count("*").alias("n"), F.bround(100 * F.avg("em"), 2).alias("em"), F.bround(100 * F.avg("f1"), 2).alias("f1"), F.bround(F.avg("n_facts"), 4).alias("avg_facts")
    )


def budget_check(scored: DataFrame, limit: float = 1.0) -> DataFrame:
    """One row: the spread of mean facts over the conditions that retrieve, and whether it is fair."""
    means = scored.filter("condition <> 'closed_book'").groupBy("condition").agg(F.avg("n_facts").alias("m"))
    return means.agg(F.bround(F.max("m") - F.min("m"), 4).alias("spread")).withColumn("fair", F.col("spread") <= limit)


def short_budgets(scored: DataFrame, k: int = 8) -> DataFrame:
    """(condition, n_short, avg_facts, em_short, em_full): rows with fewer than k facts apart from full ones."""
    short = F.col("n_facts") < k
    own = scored.filter(F.startswith("condition", F.lit("graph"))).groupBy("condition")
    return own.agg(
        F.count_if(short).alias("n_short"), F.bround(F.avg("n_facts"), 4).alias("avg_facts"),
        F.bround(100 * F.avg(F.when(short, F.col("em"))), 2).alias("em_short"), F.bround(100 * F.avg(F.when(~short, F.col("em"))), 2).alias("em_full"),
    )


def repair_outcomes(before: DataFrame, after: DataFrame, added: DataFrame) -> DataFrame:
    """(measure, n): flips to answerable, unchanged ones, those without new facts, and transitions of the mode.

    before, after: (graph_id, failure_mode, is_answerable); added: (graph_id, new_edges).
    """
    both = before.select("graph_id", F.col("failure_mode").alias("m0"), F.col("is_answerable").alias("a0")).join(
        after.select("graph_id", F.col("failure_mode").alias("m1"), F.col("is_answerable").alias("a1")), "graph_id"
    )
    both = both.join(added.select("graph_id", "new_edges"), "graph_id", "left").withColumn("new_edges", F.coalesce("new_edges", F.lit(0)))
    labels = F.array_compact(F.array(
        F.lit("attempted"), F.when(~F.col("a0") & F.col("a1"), F.lit("flipped")), F.when(F.col("a0") == F.col("a1"), F.lit("unchanged")),
        F.when(F.col("new_edges") == 0, F.lit("no_facts")), F.concat(F.col("m0"), F.lit(" -> "), F.col("m1")),
        F.when(~F.col("a1"), F.concat(F.lit("still:"), F.when(F.col("new_edges") == 0, "no_facts").otherwise(F.col("m1")))),
    ))
    return both.select(F.explode(labels).alias("measure")).groupBy("measure").agg(F.count("*").alias("n"))


def repair_totals(added: DataFrame) -> DataFrame:
    return added.agg(F.coalesce(F.sum("new_edges"), F.lit(0)).alias("new_edges"), F.count_if(F.col("new_edges") > 0).alias("samples"))


def label_rates(labels: DataFrame) -> DataFrame:
    """(kind, n, yes, no, unsure) in per cent of (kind, label) rows, over all (kind `all`) and by kind."""
    share = lambda x: F.bround(100 * F.count_if(F.col("label") == x) / F.count("*"), 1)
    every = labels.select(F.explode(F.array(F.lit("all"), F.col("kind"))).alias("kind"), "label")
    return every.groupBy("kind").agg(F.count("*").alias("n"), share("y").alias("yes"), share("n").alias("no"), share("u").alias("unsure"))


def judged(raw: Column) -> Column:
    """A judge's answer as a label: y, n, or u."""
    said = F.lower(F.ltrim(F.coalesce(raw, F.lit(""))))
    return F.when(F.startswith(said, F.lit("yes")), "y").when(F.startswith(said, F.lit("no")), "n").otherwise("u")


def agreement(pairs: DataFrame) -> DataFrame:
    """One row for (a, b) label pairs: n, raw agreement, agreement by chance, Cohen's kappa and its strength."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    sides = cells.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("x")), F.struct(F.lit(1).alias("side"), F.col("b").alias("x")))).alias("s"), "n")
    margins = sides.groupBy("s.x").agg(F.sum(F.when(F.col("s.side") == 0, F.col("n")).otherwise(0)).alias("left"), F.sum(F.when(F.col("s.side") == 1, F.col("n")).otherwise(0)).alias("right"))
    chance = margins.agg(F.sum(F.col("left") * F.col("right")).alias("products"))
    t = F.col("t")
    raw, expected = F.col("same") / t, F.col("products") / (t * t)
    kappa = F.when(expected == 1, 1.0).otherwise((raw - expected) / (1 - expected))
    out = total.join(F.broadcast(chance)).select(t.alias("n"), F.bround(raw, 6).alias("raw"), F.bround(expected, 6).alias("expected"), F.bround(kappa, 6).alias("kappa"))
    return out.withColumn("strength", F.when(F.col("kappa") >= 0.8, "strong").when(F.col("kappa") >= 0.6, "moderate").otherwise("weak"))


def fixed_sample(rows: DataFrame, id_col: str, n: int = 30, seed: int = 0) -> DataFrame:
    """The n rows of least hashed id: the same ones in every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def stuck_verdict(mode: Column, near_misses: Column, overlaps: Column, added: Column) -> Column:
    """Why a repaired sample still fails; the counts are of near misses, equal entities and added edges."""
    fixed = mode.isin("connected", "healed", "predicate_ok")
    return F.when(added == 0, "replay_empty").when(fixed, "FIXED_ON_REPLAY").when(near_misses > 0, "NEAR_MISS").when(overlaps > 0, "OTHER_GAP").otherwise("DISJOINT")


def self_loop_diagnosis(answer_hits: DataFrame, title_hits: DataFrame, neighbour_rows: DataFrame) -> DataFrame:
    """(graph_id, answers, title_nodes, shared, near): sizes and overlaps of the answer's and the last title's nodes.

    Both sides are (graph_id, entity_id); near counts title nodes next to the answer.
    """
    a, b = answer_hits.select("graph_id", "entity_id").distinct(), title_hits.select("graph_id", "entity_id").distinct()
    shared = a.join(b, ["graph_id", "entity_id"]).groupBy("graph_id").agg(F.count("*").alias("shared"))
    near = a.join(neighbour_rows, ["graph_id", "entity_id"]).select("graph_id", F.col("neighbor").alias("entity_id")).distinct()
    near = near.join(b, ["graph_id", "entity_id"]).groupBy("graph_id").agg(F.count("*").alias("near"))
    sizes = a.groupBy("graph_id").agg(F.count("*").alias("answers")).join(b.groupBy("graph_id").agg(F.count("*").alias("title_nodes")), "graph_id", "full")
    return sizes.join(shared, "graph_id", "left").join(near, "graph_id", "left").na.fill(0, ["answers", "title_nodes", "shared", "near"])
