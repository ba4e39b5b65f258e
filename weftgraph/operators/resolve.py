"""Free text to graph nodes: exact, token subset and vector tiers, each tried on what the one before left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, tokens
from .vectors import MIN_SIMILARITY, TOP_K, encode, hashing_encoder, top_k

MIN_FUZZY_LENGTH = 4


def title_entities(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """(graph_id, title, entity_id): nodes taken from the chunks of a title; blank titles are left out."""
    titled = chunks.select("graph_id", "chunk_id", normalize(F.col("title")).alias("title")).filter("title <> ''")
    return places.select("graph_id", "chunk_id", "entity_id").join(titled, ["graph_id", "chunk_id"]).select("graph_id", "title", "entity_id").distinct()


def _exploded(rows: DataFrame, text: str, name: str) -> DataFrame:
    own = rows.select("graph_id", F.col(text).alias(name), tokens(F.col(text)).alias("t"))
    return own.select("graph_id", name, F.size("t").alias(f"{name}_size"), F.explode("t").alias("token"))


def shared_tokens(labels: DataFrame, node_rows: DataFrame) -> DataFrame:
    """(graph_id, norm, entity_id, shared, norm_size, entity_id_size) of labels and nodes that share a token.

    Both sides meet by token instead of each label with each node; a token that
    is hot on one side is split by adaptive execution.
    """
    a, b = _exploded(labels, "norm", "norm"), _exploded(node_rows, "entity_id", "entity_id")
    return a.join(b, ["graph_id", "token"]).groupBy("graph_id", "norm", "entity_id", "norm_size", "entity_id_size").agg(F.count("*").alias("shared"))


def _nearest(labels: DataFrame, node_rows: DataFrame, encoder, k: int, least: float) -> DataFrame:
    """Nodes whose own label, as first written, is near to the text asked for."""
    asked = labels.select("graph_id", F.col("norm").alias("query"), encode(F.col("label"), encoder).alias("vector"))
    kept = node_rows.select("graph_id", F.col("entity_id").alias("item"), encode(F.col("label"), encoder).alias("vector"))
    return top_k(asked, kept, k, least).select("graph_id", F.col("query").alias("norm"), F.col("item").alias("entity_id"))


def resolve_entities(
    labels: DataFrame, node_rows: DataFrame, semantic: bool = False, encoder=hashing_encoder, k: int = TOP_K, least: float = MIN_SIMILARITY,
    min_length: int = MIN_FUZZY_LENGTH,
) -> DataFrame:
    """(graph_id, norm, entity_id, tier) for (graph_id, label) rows against (graph_id, entity_id, label) nodes.

    Tier 1: the node of that name. Tier 2: nodes whose tokens hold, or are held
    by, the label's, both at least `min_length` long; all of them. Tier 3, if
    `semantic`: nearest nodes. The first tier with a hit counts. Blank labels
    resolve to nothing. Labels that agree when normalised count once, as the
    least of their spellings.
    """
    asked = labels.withColumn("norm", normalize(F.col("label"))).filter("norm <> ''").groupBy("graph_id", "norm").agg(F.min("label").alias("label"))
    ids = node_rows.select("graph_id", "entity_id").distinct()
    exact = asked.join(ids.withColumn("norm", F.col("entity_id")), ["graph_id", "norm"]).select("graph_id", "norm", "entity_id")
    left = asked.join(exact, ["graph_id", "norm"], "left_anti")
    long = lambda name: F.length(name) >= min_length
    met = shared_tokens(left.filter(long("norm")), ids.filter(long("entity_id")))
    subset = met.filter((F.col("shared") == F.col("norm_size")) | (F.col("shared") == F.col("entity_id_size"))).select("graph_id", "norm", "entity_id")
    out = exact.withColumn("tier", F.lit(1)).unionByName(subset.withColumn("tier", F.lit(2)))
    if semantic:
        rest = left.join(subset, ["graph_id", "norm"], "left_anti")
        out = out.unionByName(_nearest(rest, node_rows, encoder, k, least).withColumn("tier", F.lit(3)))
    return out


def resolve_titles(
    titles: DataFrame, node_rows: DataFrame, provenance: DataFrame, semantic: bool = False, encoder=hashing_encoder, k: int = TOP_K,
    least: float = MIN_SIMILARITY, min_length: int = MIN_FUZZY_LENGTH,
) -> DataFrame:
    """(graph_id, norm, entity_id, tier) for (graph_id, title) rows.

    Tier 1 is the union of the nodes taken from the title's chunks (`provenance`,
    see `title_entities`) and the node of its name. Tier 2: nodes of at least
    `min_length` whose tokens the title holds. Tier 3, if `semantic`: nearest.
    """
    asked = titles.withColumn("norm", normalize(F.col("title"))).groupBy("graph_id", "norm").agg(F.min("title").alias("label"))
    ids = node_rows.select("graph_id", "entity_id").distinct()
    own = asked.join(provenance.withColumnRenamed("title", "norm"), ["graph_id", "norm"]).select("graph_id", "norm", "entity_id")
    named = asked.join(ids.withColumn("norm", F.col("entity_id")), ["graph_id", "norm"]).select("graph_id", "norm", "entity_id")
    first = own.union(named).distinct()
    left = asked.join(first, ["graph_id", "norm"], "left_anti")
    met = shared_tokens(left, ids.filter(F.length("entity_id") >= min_length))
    subset = met.filter(F.col("shared") == F.col("entity_id_size")).select("graph_id", "norm", "entity_id")
    out = first.withColumn("tier", F.lit(1)).unionByName(subset.withColumn("tier", F.lit(2)))
    if semantic:
        rest = left.join(subset, ["graph_id", "norm"], "left_anti")
        out = out.unionByName(_nearest(rest, node_rows, encoder, k, least).withColumn("tier", F.lit(3)))
    return out


def resolve_names(as_entity: DataFrame, as_title: DataFrame) -> DataFrame:
    """Entity resolutions, and title resolutions of names that have none."""
    both = as_entity.select("graph_id", "norm", "entity_id", F.lit(1).alias("kind")).unionByName(
        as_title.select("graph_id", "norm", "entity_id", F.lit(2).alias("kind"))
    )
    first = Window.partitionBy("graph_id", "norm")
    return both.withColumn("first", F.min("kind").over(first)).filter("kind = first").select("graph_id", "norm", "entity_id")


def hits(resolved: DataFrame) -> DataFrame:
    """(graph_id, norm, entities, tier): what each name resolves to, as a sorted array."""
    return resolved.groupBy("graph_id", "norm").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"), F.min("tier").alias("tier"))


def explain(labels: DataFrame, as_entity: DataFrame, as_title: DataFrame, provenance: DataFrame, min_length: int = MIN_FUZZY_LENGTH) -> DataFrame:
    """How each (graph_id, label) resolves: counts by kind, and what decided."""
    own = labels.select("graph_id", "label", normalize(F.col("label")).alias("norm"))
    entity = hits(as_entity).select("graph_id", "norm", F.size("entities").alias("as_entity"), F.col("tier").alias("entity_tier"))
    title = hits(as_title).select("graph_id", "norm", F.size("entities").alias("as_title"))
    indexed = provenance.select("graph_id", F.col("title").alias("norm"), F.lit(True).alias("title_indexed")).distinct()
    joined = own.join(entity, ["graph_id", "norm"], "left").join(title, ["graph_id", "norm"], "left").join(indexed, ["graph_id", "norm"], "left")
    false: Column = F.lit(False)
    return joined.select(
        "graph_id", "label", "norm",
        F.coalesce(F.col("entity_tier") == 1, false).alias("exact_hit"),
        F.coalesce("as_entity", F.lit(0)).alias("as_entity"), F.coalesce("as_title", F.lit(0)).alias("as_title"),
        F.coalesce("title_indexed", false).alias("title_indexed"), (F.length("norm") < min_length).alias("too_short"),
        F.coalesce(F.col("entity_tier") == 3, false).alias("semantic_only"),
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two names; 0 when either has none."""
    x, y = tokens(F.lower(a)), tokens(F.lower(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def near_misses(added: DataFrame, waypoints: DataFrame, least: float = 0.3) -> DataFrame:
    """(graph_id, added, waypoint, score): different entities of a graph whose tokens overlap by more than `least`.

    Pairs that share no token score 0, so both sides meet by token.
    """
    a = added.select("graph_id", F.col("entity_id").alias("added"), F.explode(tokens(F.lower("entity_id"))).alias("token"))
    b = waypoints.select("graph_id", F.col("entity_id").alias("waypoint"), F.explode(tokens(F.lower("entity_id"))).alias("token"))
    met = a.join(b, ["graph_id", "token"]).filter("added <> waypoint").select("graph_id", "added", "waypoint").distinct()
    return met.withColumn("score", token_jaccard(F.col("added"), F.col("waypoint"))).filter(F.col("score") > least)
