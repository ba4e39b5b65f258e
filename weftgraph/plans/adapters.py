"""Tables of the test data as samples, chunks, facts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.hypergraph import hyperedges

MAX_ARITY = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_articles(docs: DataFrame) -> DataFrame:
    """A document as a sample with one article, its source the title; sentences end at `. `."""
    return docs.select(
        F.col("doc_id").alias("graph_id"), F.lit(0).alias("article_pos"), F.col("source").alias("title"),
        F.split(F.coalesce("text", F.lit("")), r"\. ").alias("sentences"), F.array(F.lit(0), F.lit(4), F.lit(9)).alias("gold"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


def order_keys(spark: SparkSession, sf_dir: str, key: str = "l_partkey") -> DataFrame:
    """A row for each order of a customer, with the keys of its lines: all that order_chunks says, in few bytes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", key))), lambda x: x[key])
    return order_lines(spark, sf_dir).groupBy("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority").agg(ordered.alias("keys"))


def chunks_of(keys: DataFrame, prefix: str = "part:") -> DataFrame:
    """The chunks of order_keys rows."""
    own = keys.withColumn("raw_entities", F.transform("keys", lambda x: F.concat(F.lit(prefix), x.cast("string"))))
    return own.select(
        F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("chunk_idx"), F.col("o_orderkey").cast("string").alias("chunk_id"),
        F.col("o_orderpriority").alias("title"), F.array(F.concat(F.lit("Order of "), F.array_join("raw_entities", " and "))).alias("sentences"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("gold_sentence_offsets"),
        "raw_entities",
    )


def order_chunks(spark: SparkSession, sf_dir: str, key: str = "l_partkey", prefix: str = "part:") -> DataFrame:
    """A chunk for each order of a customer, titled by its priority, with one sentence that names its parts."""
    return chunks_of(order_keys(spark, sf_dir, key), prefix)


def order_edges(chunks: DataFrame) -> DataFrame:
    """Hyperedges of orders of up to MAX_ARITY lines: their parts, related by the priority."""
    facts = chunks.filter(F.size("raw_entities") <= MAX_ARITY).select(
        "graph_id", "chunk_idx", F.lit(0).alias("fact_pos"), "chunk_id", "raw_entities", F.col("title").alias("relation"),
        F.lit(0).alias("sentence_index"), F.lit(1.0).alias("confidence"), "sentences", "gold_sentence_offsets",
    )
    return hyperedges(facts)


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges of a nation's orders over suppliers, where pairs repeat."""
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), "c_nationkey")
    facts = order_chunks(spark, sf_dir, "l_suppkey", "supp:").join(nations, "graph_id").drop("graph_id").withColumnRenamed("c_nationkey", "graph_id")
    return order_edges(facts)


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each line, with few enough names that facts of one customer (the chunk) repeat; a third in reverse order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a = F.concat(F.lit(" Part "), (F.col("l_partkey") % 4).cast("string"))
    b = F.concat(F.lit("SUPP "), (F.col("l_suppkey") % 3).cast("string"), F.lit(" "))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        (F.col("o_custkey") % 100).alias("graph_id"), F.col("o_orderkey").alias("chunk_idx"), F.col("l_linenumber").cast("int").alias("fact_pos"),
        F.col("o_custkey").cast("string").alias("chunk_id"), F.when(F.col("l_orderkey") % 3 == 0, F.array(b, a)).otherwise(F.array(a, b)).alias("raw_entities"),
        F.col("l_returnflag").alias("relation"), F.pmod("l_linenumber", F.lit(3)).cast("int").alias("sentence_index"), F.lit(0.5).alias("confidence"),
        F.array(F.lit("first"), F.lit("second"), F.lit("third")).alias("sentences"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1))).alias("gold_sentence_offsets"),
    )


def audit_samples(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """A question for each customer with orders: entities, answer, gold titles and kind by rules that reach every verdict."""
    first = F.min_by(F.struct("title", "raw_entities"), "chunk_idx")
    last = F.max_by(F.struct("title", "raw_entities"), "chunk_idx")
    parts = F.max(F.array_max(F.transform("raw_entities", lambda e: F.substring(e, 6, 20).cast("long"))))
    own = chunks.groupBy("graph_id").agg(first.alias("first"), last.alias("last"), parts.alias("most"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), "c_mktsegment")
    own = own.join(customers, "graph_id")
    g = F.col("graph_id")
    titles = F.array_distinct(F.array("first.title", "last.title"))
    asked = (
        F.when(g % 10 == 3, F.array().cast("array<string>")).when(g % 10 == 4, F.array(F.lit("nowhere"), F.lit("unknown thing")))
        .otherwise(F.array(F.get("first.raw_entities", 0), F.element_at("last.raw_entities", -1)))
    )
    answer = F.when(g % 7 == 0, F.lit("yes")).when(g % 7 == 1, F.col("c_mktsegment")).when(g % 7 == 2, F.get(titles, 0)).otherwise(F.concat(F.lit("part:"), F.col("most").cast("string")))
    kind = F.when(g % 50 == 7, "other").when(g % 2 == 0, "bridge").otherwise("comparison")
    gold = F.transform(titles, lambda t, i: F.struct(i.alias("pos"), t.alias("title"), F.array(F.lit(0)).alias("sent_ids")))
    return own.select(
        "graph_id", F.concat(F.lit("Which part belongs to customer "), g.cast("string"), F.lit("?")).alias("question"), answer.alias("answer"),
        kind.alias("hop_type"), gold.alias("gold"), asked.alias("question_entities"), F.when(g % 11 == 0, 1).otherwise(0).cast("long").alias("parse_failures"),
    )


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, entity_id, label): distinct part names as nodes of one graph."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("entity_id")).distinct()
    return names.select(F.lit(0).alias("graph_id"), "entity_id", F.initcap("entity_id").alias("label"))


def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, label): names as they are, reversed with a word more, their first words, and one that is nowhere."""
    names = part_names(spark, sf_dir).select("entity_id")
    words = F.split("entity_id", " ")
    every = F.array(F.upper("entity_id"), F.concat(F.array_join(F.reverse(words), " "), F.lit(" deluxe")), F.get(words, 0), F.lit("zzz"), F.lit(" "))
    return names.select(F.lit(0).alias("graph_id"), F.explode(every).alias("label")).distinct()


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns as (gold, pred), dealt over conditions; whole texts."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    paired = own.withColumn("next", after).filter("next is not null")
    condition = F.get(F.array(*(F.lit(c) for c in ("closed_book", "text_rag", "graph", "graph_repair"))), F.pmod(F.col("conv_id"), F.lit(4)).cast("int"))
    pred = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The "), F.upper("text"), F.lit("!"))).otherwise(F.col("next"))
    n_facts = F.when(condition == "closed_book", 0).otherwise(4 + F.pmod("turn", F.lit(5))).cast("int")
    return paired.select(
        "conv_id", "turn", condition.alias("condition"), F.col("text").alias("gold"), pred.alias("pred"), n_facts.alias("n_facts"),
        (F.col("turn") % 2 == 0).alias("answerable"),
    )
