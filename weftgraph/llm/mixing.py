"""Mixing sources to target weights.

Every row gets a hash-random key. Within its source, rows stand in the order of
that key; sums of words by key range, added up over the ranges of a source,
give each range the words before it, and a running sum inside the range does
the rest. So no source is ever sorted in one task: a range holds about
`range_rows` rows whatever the source's share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, if_small, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Adds `target` to (source, source_size), one row a source.

    Sources by code point, null last, weigh `weights` in turn. The words to take
    are `share` of all words, dealt by weight; a target above `max_repeat` times
    its source's size stops there and the excess is dealt again by weight. Where
    that ends is found at once: sources are capped in the order of size over
    weight, up to the first for which the level of those left is within its cap.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % n + 1).cast("int"))
    ranked = sources.withColumn("rank", rank).withColumn("weight", weight.cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("left")
    ranked = (
        ranked.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("water", F.max(F.when(F.col("open"), F.struct(-F.col("before"), F.col("level")))).over(everything)["level"])
    )
    cap = F.col("cap").cast("double")
    target = F.coalesce(F.least(cap, F.col("water") * F.col("weight")), cap)
    return ranked.select("source", "source_size", "n", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple = (1, 2, 3), share: float = 1.0, max_repeat: int = 3, seed: str = "mix", range_rows: int = 2048
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `docs`; see `targets`.

    The mix takes a source's rows whole as often as its budget (its target,
    rounded) holds all its words, then once more in the order of their keys, the
    row at the cut in part, so that a source's taken words sum to its budget.
    Null texts have size 0. A key depends on doc_id and seed alone, so reruns
    agree; rows that share a doc_id stand by size. Only doc_id, text and source
    are read. An empty table gives an empty result.
    """
    slim = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size")))
    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, max_repeat)
    sources = cut(
        sources.withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n") / range_rows))
        .withColumnRenamed("source", "of")
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = slim.join(if_small(sources, 100_000), F.col("source").eqNullSafe(F.col("of")), "inner").withColumn("key", key)
    point = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("range", F.shiftright(point * F.col("ranges"), 32))
    sums = keyed.groupBy("of", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("of").alias("at"), F.col("range").alias("at_range"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")
    )
    same = F.col("of").eqNullSafe(F.col("at")) & (F.col("range") == F.col("at_range"))
    inside = (
        Window.partitionBy("of", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - start))
    return keyed.join(if_small(sums), same, "inner").select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken")
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, 3 * source_size as cap, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight,
         row_number() over (order by source nulls last) as rank
  from s),
l as (
  select *, cast(coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
         cast(sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as bigint) as rest_weight,
         cast(sum(source_size) over () as double) as total
  from w),
v as (
  select *, (total - before) / rest_weight as level from l),
g as (
  select arg_min(level, before) filter (where level <= cap / weight) as water from v),
t as (
  select source, source_size, coalesce(least(cast(cap as double), water * weight), cast(cap as double)) as target from v, g),
b as (
  select *, cast(floor(target + 0.5) as bigint) as budget from t),
e as (
  select d.doc_id, d.size, b.source_size, b.target, b.budget,
         case when b.source_size > 0 then b.budget // b.source_size else 0 end as epochs,
         coalesce(sum(d.size) over (partition by d.source order by md5('mix:' || coalesce(cast(d.doc_id as varchar), '')), d.doc_id, d.size
                  rows between unbounded preceding and 1 preceding), 0) as start
  from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       cast(epochs * size + least(size, greatest(0, budget - epochs * source_size - start)) as bigint) as taken
from e
"""
