"""The catalogue: each operator applied to the test tables, with the same result in SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, chunking, components, facts, hypergraph, metrics, projection, repair, resolve, retrieve, vectors
from . import adapters as A
from . import flows
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return A.order_edges(A.order_chunks(spark, sf))


# --- chunks and text ---------------------------------------------------------------------------


@query(f"with {O.CHUNKS} select doc_id as graph_id, idx as chunk_idx, doc_id || '_' || idx as chunk_id, st as start_sentence, len(w) as n_sentences, md5(array_to_string(w, ' ')) as text_md5 from c")
def q01_chunk_windows(spark, sf):
    c = chunking.sentence_chunks(A.document_articles(A.table(spark, sf, "documents")))
    return c.select("graph_id", "chunk_idx", "chunk_id", "start_sentence", F.size("sentences").alias("n_sentences"), F.md5(F.array_join("sentences", " ")).alias("text_md5"))


@query(f"with {O.CHUNKS} select doc_id || '_' || idx as chunk_id, array_to_string(list_transform(list_filter([0, 4, 9], lambda x: x >= st and x < st + len(w)), lambda x: x - st), ',') as offsets from c")
def q02_chunk_gold_offsets(spark, sf):
    c = chunking.sentence_chunks(A.document_articles(A.table(spark, sf, "documents")))
    return c.select("chunk_id", F.array_join(F.transform("gold_sentence_offsets", lambda x: x.cast("string")), ",").alias("offsets"))


@query(f"""with {O.CHUNKS}, s as (select count(*) as samples, count(*) filter (where doc_id % 2 = 0) as bridge, count(*) filter (where doc_id % 2 = 1) as comparison from documents),
 n as (select count(*) as chunks from c) select samples, bridge, comparison, chunks, round_even(chunks / greatest(samples, 1), 1) as avg_chunks from s, n""")
def q03_dataset_summary(spark, sf):
    docs = A.table(spark, sf, "documents")
    samples = docs.select(F.when(F.col("doc_id") % 2 == 0, "bridge").otherwise("comparison").alias("hop_type"))
    return chunking.dataset_summary(samples, chunking.sentence_chunks(A.document_articles(docs)))


@query("select p_partkey, lower(p_name) as norm, len(list_distinct(string_split(lower(p_name), ' '))) as n_tokens from part")
def q04_normalize_labels(spark, sf):
    label = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("\n"))
    return A.table(spark, sf, "part").select("p_partkey", text.normalize(label).alias("norm"), F.size(text.tokens(F.lower(label))).alias("n_tokens"))


@query(f"with {O.CHUNKS}, k as (select md5(array_to_string(w, chr(0))) as content_key, doc_id, idx from c) select content_key, count(*) as chunks, min(doc_id) as first_doc from k group by content_key")
def q05_content_key_dedup(spark, sf):
    c = chunking.sentence_chunks(A.document_articles(A.table(spark, sf, "documents")))
    return c.groupBy(text.content_key(F.col("sentences")).alias("content_key")).agg(F.count("*").alias("chunks"), F.min("graph_id").alias("first_doc"))


@query(r"""with d as (select doc_id, regexp_extract(text, '[A-Za-z]+ ([A-Za-z]+)', 1) as answer, string_split(text, '. ') as s from documents)
 select doc_id, coalesce(lower(answer) not in ('', 'yes', 'no') and len(list_filter(s, lambda x: regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])' || lower(answer) || '($|[^\p{L}\p{N}_])'))) > 0, false) as grounded from d""")
def q06_text_grounding(spark, sf):
    docs = A.table(spark, sf, "documents")
    answer = F.regexp_extract("text", "[A-Za-z]+ ([A-Za-z]+)", 1)
    return docs.select("doc_id", text.grounded(answer, F.split("text", r"\. ")).alias("grounded"))


# --- facts -------------------------------------------------------------------------------------

#: By order key modulo 14: a raw fact, and why it is refused.
_RAW = (
    ('{"entities":["a","b"],"relation":"likes","sentence_index":0,"confidence":0.5}', "valid"), ('"text"', "not_a_dict"),
    ('{"entities":"a","relation":"likes","sentence_index":0,"confidence":0.5}', "bad_entity_list"),
    ('{"entities":["a"],"relation":"likes","sentence_index":0,"confidence":0.5}', "too_few_entities"),
    ('{"entities":["a","b","c","d","e","f","g"],"relation":"likes","sentence_index":0,"confidence":0.5}', "too_many_entities"),
    ('{"entities":["a"," "],"relation":"likes","sentence_index":0,"confidence":0.5}', "blank_entity"),
    ('{"entities":["a",1],"relation":"likes","sentence_index":0,"confidence":0.5}', "blank_entity"),
    ('{"entities":["a","b"],"relation":7,"sentence_index":0,"confidence":0.5}', "bad_relation"),
    ('{"entities":["a","b"],"relation":" <rel>","sentence_index":0,"confidence":0.5}', "placeholder_relation"),
    ('{"entities":["a","b"],"relation":"likes","sentence_index":true,"confidence":0.5}', "bad_sentence_index"),
    ('{"entities":["a","b"],"relation":"likes","sentence_index":1.0,"confidence":0.5}', "bad_sentence_index"),
    ('{"entities":["a","b"],"relation":"likes","sentence_index":3,"confidence":0.5}', "index_out_of_range"),
    ('{"entities":["a","b"],"relation":"likes","sentence_index":2,"confidence":1.5}', "bad_confidence"),
    ('{"entities":["a","b"],"relation":"likes","sentence_index":2,"confidence":true}', "bad_confidence"),
)


@query(f"with w as (select ['{"','".join(r for _, r in _RAW)}'][o_orderkey % 14 + 1] as reason from orders) select reason, count(*) as facts from w group by reason")
def q07_fact_validation_reasons(spark, sf):
    fact = F.get(F.array(*(F.lit(f) for f, _ in _RAW)), (F.col("o_orderkey") % 14).cast("int"))
    raw = F.concat(F.lit("<think>[]</think>```json["), fact, F.lit("]```"))
    sentences = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    responses = A.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), raw.alias("raw"), sentences.alias("sentences"))
    checked = facts.checked_facts(responses)
    return checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("facts"))


# --- hypergraph --------------------------------------------------------------------------------


@query(f"with {O.LINES} select g as graph_id, chunk as chunk_id, ok, ln, rel as relation, least(a, b) || '|' || greatest(a, b) as names, ['first', 'second', 'third'][si + 1] as sentence, case when fin then si in (0, 2) else si = 1 end as is_gold from k")
def q08_edge_dedup(spark, sf):
    e = hypergraph.hyperedges(A.line_facts(spark, sf))
    return e.select(
        "graph_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("edge_seq.chunk_idx").alias("ok"), F.col("edge_seq.fact_pos").alias("ln"), "relation",
        F.array_join(F.array_sort("entities"), "|").alias("names"), "sentence", "is_gold",
    )


@query(f"""with {O.LINES}, x as (
 select g, chunk, ok, ln, rel, a, b, a as node, ' Part ' || substr(a, 6) as label, case when turned then 1 else 0 end as pos from k
 union all select g, chunk, ok, ln, rel, a, b, b, 'SUPP ' || substr(b, 6) || ' ', case when turned then 0 else 1 end from k)
 select g as graph_id, node as entity_id, arg_min(label, (ok, ln, pos)) as label, count(distinct chunk) as n_chunks, count(distinct (chunk, rel, a, b)) as n_edges, arg_min(chunk, (ok, ln, pos)) as first_chunk
 from x group by g, node""")
def q09_nodes_first_label(spark, sf):
    n = hypergraph.nodes(hypergraph.incidence(hypergraph.hyperedges(A.line_facts(spark, sf))))
    return n.select("graph_id", "entity_id", "label", F.size("chunks").alias("n_chunks"), F.size("edges").alias("n_edges"), F.get("chunks", 0).cast("long").alias("first_chunk"))


@query(f"""with {O.ORDERS} select e.g as graph_id, any_value(n.nodes) as nodes, count(*) as edges, count(*) filter (where gold) as gold_edges, round_even(sum(len(ents)) / count(*), 2) as avg_arity
 from e join (select g, count(*) as nodes from nodes group by g) n using (g) group by e.g""")
def q10_graph_summary(spark, sf):
    return hypergraph.graph_summary(_edges(spark, sf))


@query(f"with {O.ORDERS} select distinct g as graph_id, src as entity_id, dst as neighbor from both_ways")
def q11_neighbors(spark, sf):
    return hypergraph.neighbors(hypergraph.incidence(_edges(spark, sf)))


@query(f"with {O.NATIONS} select pp.g as graph_id, src, dst, count(*) as n_edges, bool_or(gold) as is_gold, min(pp.ok) as first_edge from pp join e on e.g = pp.g and e.ok = pp.ok group by pp.g, src, dst")
def q12_clique_pairs(spark, sf):
    e = A.nation_edges(spark, sf)
    p = projection.pairs(e)
    first = e.select("graph_id", "edge_id", F.col("edge_seq.chunk_idx").alias("first_edge"))
    named = p.withColumn("edge_id", F.get("edge_ids", 0)).join(first, ["graph_id", "edge_id"])
    return named.select("graph_id", "src", "dst", F.size("edge_ids").cast("long").alias("n_edges"), "is_gold", "first_edge")


@query(f"""with {O.NATIONS} select g as graph_id, src, dst, ok from (
 select pp.*, row_number() over (partition by pp.g, src, dst order by gold desc, len(ents) desc, pp.ok) as k from pp join e on e.g = pp.g and e.ok = pp.ok) where k = 1""")
def q13_best_edge_for_hop(spark, sf):
    e = A.nation_edges(spark, sf)
    return projection.best_edge(e).join(e.select("graph_id", "edge_id", F.col("edge_seq.chunk_idx").alias("ok")), ["graph_id", "edge_id"]).select("graph_id", "src", "dst", "ok")


@query(f"""with recursive {O.ORDERS}, {O.PARTS},
 n as (select g, count(*) as nodes from nodes group by g), m as (select g, count(*) as m from pairs group by g),
 h as (select g, count(*) as hyperedges, max(len(list_distinct(ents))) as max_arity from e group by g), c as (select g, count(distinct comp) as components from parts group by g)
 select n.g as graph_id, nodes, m as projected_edges, hyperedges, round_even(2 * m / nodes, 2) as avg_degree, max_arity, 0 as self_loops, components,
 round_even(2 * m / (nodes * (nodes - 1)), 4) as density from n join m using (g) join h using (g) join c using (g)""")
def q14_graph_stats(spark, sf):
    return projection.graph_stats(_edges(spark, sf))


@query(f"with recursive {O.ORDERS}, {O.PARTS} select g as graph_id, node, comp as component from parts")
def q15_components(spark, sf):
    return components.components(projection.pairs(_edges(spark, sf)))


@query(f"""with recursive {O.ORDERS}, s as (select g, min(node) as source from nodes group by g),
 w(g, source, node, h) as (select g, source, source, 0 from s union select w.g, w.source, b.dst, w.h + 1 from w join both_ways b on b.g = w.g and b.src = w.node where w.h < 12)
 select g as graph_id, source, node, min(h) as hops from w group by g, source, node""")
def q16_bfs_hops(spark, sf):
    e = _edges(spark, sf)
    sources = hypergraph.incidence(e).groupBy("graph_id").agg(F.min("entity_id").alias("source"))
    return components.hop_counts(projection.pairs(e), sources)


# --- resolution --------------------------------------------------------------------------------


@query(f"with {O.NAMES} select norm, node as entity_id from exact")
def q17_resolve_exact(spark, sf):
    r = resolve.resolve_entities(A.name_labels(spark, sf), A.part_names(spark, sf))
    return r.filter("tier = 1").select("norm", "entity_id")


@query(f"with {O.NAMES} select norm, node as entity_id from subset")
def q18_resolve_token_subset(spark, sf):
    r = resolve.resolve_entities(A.name_labels(spark, sf), A.part_names(spark, sf))
    return r.filter("tier = 2").select("norm", "entity_id")


@query(f"with {O.NAMES} select norm, min(tier) as tier, count(*) as hits, min(node) as first_hit from res group by norm")
def q19_resolve_cascade(spark, sf):
    r = resolve.hits(resolve.resolve_entities(A.name_labels(spark, sf), A.part_names(spark, sf)))
    return r.select("norm", "tier", F.size("entities").cast("long").alias("hits"), F.get("entities", 0).alias("first_hit"))


@query(f"""with {O.ORDERS} select e.g as graph_id, lower(e.pr) as title, count(distinct node) as hits, min(node) as first_hit from e join inc on inc.g = e.g and inc.ok = e.ok group by all""")
def q20_title_entities(spark, sf):
    chunks = A.order_chunks(spark, sf)
    graph_places = hypergraph.incidence(A.order_edges(chunks))
    titles = chunks.select("graph_id", "title").distinct()
    nodes = hypergraph.nodes(graph_places)
    r = resolve.hits(resolve.resolve_titles(titles, nodes, resolve.title_entities(graph_places, chunks)))
    return r.select("graph_id", F.col("norm").alias("title"), F.size("entities").cast("long").alias("hits"), F.get("entities", 0).alias("first_hit"))


@query(f"""with {O.NAMES}, t as (select norm, count(*) as c, min(tier) as tier from (
   select norm, node, tier from exact union all
   select norm, node, 2 from l, n where norm not in (select norm from exact) and length(node) >= 4 and list_has_all(string_split(norm, ' '), string_split(node, ' '))) group by norm),
 r as (select norm, count(*) as c, min(tier) as tier from res group by norm)
 select norm, coalesce(r.tier = 1, false) as exact_hit, coalesce(r.c, 0) as as_entity, coalesce(t.c, 0) as as_title, false as title_indexed, length(norm) < 4 as too_short, false as semantic_only
 from l left join r using (norm) left join t using (norm)""")
def q21_explain_labels(spark, sf):
    labels, nodes = A.name_labels(spark, sf), A.part_names(spark, sf)
    none = nodes.select("graph_id", F.col("label").alias("title"), "entity_id").limit(0)
    as_title = resolve.resolve_titles(labels.withColumnRenamed("label", "title"), nodes, none)
    out = resolve.explain(labels, resolve.resolve_entities(labels, nodes), as_title, none)
    return out.filter("norm <> ''").drop("graph_id", "label").distinct()


_TOP = """with q as (select vec_id as query, embedding as v from embeddings where vec_id % 20 = 0),
 s as (select query, vec_id as item, list_inner_product(list_transform(v, lambda x: x::double), list_transform(embedding, lambda x: x::double)) as sim from q, embeddings),
 r as (select *, row_number() over (partition by query order by sim desc, item) as rank from s)"""


def _vector_hits(spark, sf, k, least):
    v = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    asked = v.filter("item % 20 = 0").withColumnRenamed("item", "query")
    return vectors.top_k(asked, v, k, least, on=()).select("query", "item", "rank", F.round("sim", 4).alias("sim"))


@query(f"{_TOP} select query, item, rank, round(sim, 4) as sim from r where rank <= 3")
def q22_vector_topk(spark, sf):
    return _vector_hits(spark, sf, 3, -1.0)


@query(f"{_TOP} select query, item, rank, round(sim, 4) as sim from r where rank <= 10 and sim >= 0.3")
def q23_vector_threshold(spark, sf):
    return _vector_hits(spark, sf, 10, 0.3)


# --- retrieval ---------------------------------------------------------------------------------


def _starts(edges: DataFrame) -> DataFrame:
    return hypergraph.incidence(edges).groupBy("graph_id").agg(F.min("entity_id").alias("entity_id"))


@query(f"""with {O.ORDERS}, s as (select g, min(node) as node from nodes group by g),
 e1 as (select distinct inc.g, inc.ok from inc join s using (g, node)), n1 as (select distinct inc.g, inc.node from inc join e1 using (g, ok)),
 e2 as (select distinct inc.g, inc.ok from inc join n1 using (g, node)) select g as graph_id, ok from e1 union select g, ok from e2""")
def q24_khop_edges(spark, sf):
    e = _edges(spark, sf)
    near = retrieve.khop_edges(_starts(e), hypergraph.incidence(e))
    return near.join(e, ["graph_id", "edge_id"]).select("graph_id", F.col("edge_seq.chunk_idx").alias("ok"))


@query()
def q25_beam_search(spark, sf):
    chunks = A.order_chunks(spark, sf)
    e = A.order_edges(chunks)
    scored = retrieve.scored_edges(A.audit_samples(spark, sf, chunks), e)
    return retrieve.beam_search(scored, _starts(e), least=0.0)


@query()
def q26_text_rag_topk(spark, sf):
    docs = A.table(spark, sf, "documents")
    chunks = chunking.sentence_chunks(A.document_articles(docs))
    asked = docs.select(F.col("doc_id").alias("graph_id"), F.col("text").alias("question"))
    return retrieve.text_evidence(asked, chunks)


@query(f"""with {O.NAMES}, p as (select node as e1, 'zzz' as e2, node as t1, string_split(node, ' ')[2] as t2 from n)
 select e1, e2, t1 as title1, case when contains(e2, t2) or contains(t2, e2) then t2 end as title2 from p""")
def q27_pair_titles(spark, sf):
    names = A.part_names(spark, sf).select(F.col("entity_id").alias("e1"), F.lit("zzz").alias("e2"), F.col("entity_id").alias("t1"), F.get(F.split("entity_id", " "), 1).alias("t2"))
    item = lambda i, c: F.struct(F.lit(i).alias("pos"), F.col(c).alias("label"), F.col(c).alias("norm"))
    pairs = audit.paired(F.array(item(0, "e1"), item(1, "e2")), F.array(item(0, "t1"), item(1, "t2")), audit.empty("struct<entity:string,title:string>"))
    out = names.withColumn("p", pairs)
    return out.select("e1", "e2", F.get("p", 0)["title"]["label"].alias("title1"), F.get("p", 1)["title"]["label"].alias("title2"))


def _audited(spark, sf):
    # edges, samples and the audit gather by graph; keys are stored and dealt, and names and sentences are made of them behind that
    chunks = A.chunks_of(flows.stored(A.order_keys(spark, sf)).repartition("o_custkey"))
    graph = flows.Graph(A.order_edges(chunks), chunks)
    samples = flows.stored(A.audit_samples(spark, sf, chunks))
    reports, chains = flows.audit_reports(samples, graph)
    return samples, graph, reports, chains




# --- audit -------------------------------------------------------------------------------------


@query(f"with recursive {O.AUDIT} select g as graph_id, chain_pos, breaks as n_breaks, heals as n_heals, linked as is_connected from best")
def q28_chain_segments(spark, sf):
    chains = _audited(spark, sf)[3].filter("terminal is not null")
    line = F.col("segments")
    return chains.select("graph_id", "chain_pos", audit.breaks(line).alias("n_breaks"), audit.heals(line).alias("n_heals"), audit.is_connected(line).alias("is_connected"))


@query(f"with recursive {O.AUDIT} select g as graph_id, chain_pos, status, trivial as is_trivial, grounded as text_grounded from best")
def q29_terminal_status(spark, sf):
    chains = _audited(spark, sf)[3].filter("terminal is not null")
    return chains.select("graph_id", "chain_pos", "terminal.status", "terminal.is_trivial", "terminal.text_grounded")


@query(f"with recursive {O.AUDIT} select g as graph_id, chain_pos, mode as failure_mode from md")
def q30_chain_failure_mode(spark, sf):
    chains = _audited(spark, sf)[3].filter("terminal is not null")
    return chains.select("graph_id", "chain_pos", audit.chain_mode(F.col("segments"), F.col("terminal")).alias("failure_mode"))


@query(f"with recursive {O.AUDIT} select md.g as graph_id, arg_min(md.mode, rank) as worst from md join sev using (mode) group by md.g")
def q31_worst_mode(spark, sf):
    chains = _audited(spark, sf)[3].filter("terminal is not null")
    modes = F.collect_list(audit.chain_mode(F.col("segments"), F.col("terminal")))
    return chains.groupBy("graph_id").agg(audit.worst_mode(modes).alias("worst"))


@query(f"with recursive {O.AUDIT} select sample_id, failure_mode, is_answerable, num_heals, terminal from rep where hop_type = 'bridge'")
def q32_bridge_best_chain(spark, sf):
    r = _audited(spark, sf)[2].filter("hop_type = 'bridge'")
    return r.select("sample_id", "failure_mode", "is_answerable", "num_heals", F.array_join("terminal", ",").alias("terminal"))


@query(f"with recursive {O.AUDIT} select sample_id, failure_mode, is_answerable, num_reasoning_chains, terminal from rep where hop_type = 'comparison'")
def q33_comparison_report(spark, sf):
    r = _audited(spark, sf)[2].filter("hop_type = 'comparison'")
    return r.select("sample_id", "failure_mode", "is_answerable", "num_reasoning_chains", F.array_join("terminal", ",").alias("terminal"))


@query(f"with recursive {O.AUDIT} select * from rep")
def q34_report_summary(spark, sf):
    lists = {c: F.array_join(c, ",") for c in ("question_entities", "terminal", "supporting_titles")}
    return _audited(spark, sf)[2].withColumns(lists).drop("chain_terminals")


@query(f"""with recursive {O.AUDIT}, x as (
 select unnest(list_filter(['samples', case when is_answerable then 'answerable' end, case when is_clean then 'clean' end, case when is_repairable then 'repairable' end,
  case when trivial_terminal then 'trivial_terminal' end, case when genuine_terminal then 'genuine_terminal' end, case when text_grounded then 'text_grounded' end,
  case when parse_failures > 0 then 'with_parse_failures' end, case when parse_failures = 0 then 'without_parse_failures' end,
  case when parse_failures = 0 and is_answerable then 'answerable_without_parse_failures' end, 'mode:' || failure_mode], lambda m: m is not null)) as measure from rep
 union all select 'status:' || status from best) select measure, count(*) as value from x group by measure""")
def q35_corpus_rollup(spark, sf):
    return metrics.corpus_rollup(_audited(spark, sf)[2])


# --- metrics -----------------------------------------------------------------------------------


@query(f"with {O.ORDERS} select len(list_distinct(ents)) as arity, count(*) as edges from e group by 1")
def q36_arity_hist(spark, sf):
    return metrics.arity_histogram(_edges(spark, sf))


@query(f"with {O.ORDERS} select rel as relation, count(*) as edges from e group by rel order by count(*) desc, min((g, ok)) limit 3")
def q37_relation_topn(spark, sf):
    return metrics.relation_histogram(_edges(spark, sf), 3)


@query(f"""with {O.ORDERS} select g as graph_id, round(avg(case when len(tk) > 0 and not list_has_any(tk, string_split('order ' || rel2, ' ')) then 1.0 else 0.0 end), 9) as rate from (
 select g, list_filter(string_split(rel, '_'), lambda x: length(x) > 2) as tk, case when ok % 2 = 0 then rel else 'nothing' end as rel2 from e) group by g""")
def q38_contamination(spark, sf):
    e = _edges(spark, sf)
    said = F.concat(F.lit("Order: "), F.when(F.col("edge_seq.chunk_idx") % 2 == 0, F.col("relation")).otherwise("nothing"), F.lit("."))
    return metrics.contamination(e.withColumn("sentence", said)).select("graph_id", F.round("rate", 9).alias("rate"))


@query(f"""with recursive {O.AUDIT}, b as (
 select g, chain_pos, kind, status, trivial, linked, status = 'entity_reached' and not trivial as real from best),
 k as (select *, row_number() over (partition by g order by chain_pos) as i, count(*) over (partition by g) as n from b),
 l as (select g, case when kind = 'bridge' then 'bridge' else 'comparison' end as kind, i, n, status, real, trivial, linked from k),
 ls as (select kind, unnest(list_filter(case when status = 'entity_reached' and not linked then ['reached_but_disconnected', case when real then 'reached_but_disconnected_genuine' end]
   else [status, case when status = 'entity_reached' then case when real then 'genuine+reached' else 'trivial+reached' end
     when status = 'entity_unreached' then case when trivial then 'trivial+unreached' else 'genuine-attempt+unreached' end end] end, lambda x: x is not null)) as label
   from l where (kind = 'bridge' and i = 1) or (kind = 'comparison' and n > 1 and i <= 2)),
 mk as (select g, i, status, status || ' | G=' || case when real then 'Y' else 'N' end || ' T=' || case when trivial then 'Y' else 'N' end as m from l where kind = 'comparison' and n > 1 and i <= 2),
 cr as (select unnest([x.status || ' x ' || y.status, x.m || ' <-> ' || y.m]) as label from mk x join mk y on x.g = y.g and x.i = 1 and y.i = 2),
 sh as (select case when kind = 'bridge' then 'bridge' else 'comparison' end as kind, 'short' as label from sm left join (select g, count(*) as n from b group by g) c using (g)
   where coalesce(n, 0) < case when kind = 'bridge' then 1 else 2 end),
 every as (select kind, label from ls union all select 'comparison', label from cr union all select kind, label from sh)
 select kind, label, count(*) as n from every group by all""")
def q39_terminal_crosstab(spark, sf):
    return metrics.terminal_crosstab(_audited(spark, sf)[2])


@query(f"with {O.ANSWERS} select conv_id, turn, em, round(f1, 9) as f1 from sc")
def q40_em_f1(spark, sf):
    return metrics.scored_answers(A.answers(spark, sf)).select("conv_id", "turn", "em", F.round("f1", 9).alias("f1"))


def _percents(*columns: str) -> str:
    return ", ".join(f"round_even(100 * avg({c}), 2) as {c}" for c in columns) + ", round_even(avg(n_facts), 4) as avg_facts"


@query(f"with {O.ANSWERS} select condition, answerable, count(*) as n, {_percents('em', 'f1')} from sc group by all")
def q41_em_f1_by_condition(spark, sf):
    return metrics.by_condition(metrics.scored_answers(A.answers(spark, sf)), "answerable")


@query(f"""with {O.ANSWERS}, m as (select condition, avg(n_facts) as m from p where condition <> 'closed_book' group by condition)
 select round_even(max(m) - min(m), 4) as spread, round_even(max(m) - min(m), 4) <= 1.0 as fair from m""")
def q42_budget_check(spark, sf):
    return metrics.budget_check(A.answers(spark, sf))


@query("""with x as (select quality as a, 1 - toxic as b from labels), t as (select count(*) as n, count(*) filter (where a = b) as same from x),
 m as (select sum(l * r) as products from (select v, count(*) filter (where s = 0) as l, count(*) filter (where s = 1) as r from (select a as v, 0 as s from x union all select b, 1 from x) group by v)),
 k as (select n, same / n as raw, products / (n * n) as expected from t, m), z as (select *, case when expected = 1 then 1.0 else (raw - expected) / (1 - expected) end as kappa from k)
 select n, round_even(raw, 6) as raw, round_even(expected, 6) as expected, round_even(kappa, 6) as kappa, case when kappa >= 0.8 then 'strong' when kappa >= 0.6 then 'moderate' else 'weak' end as strength from z""")
def q43_kappa(spark, sf):
    return metrics.agreement(A.table(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))


@query("""with x as (select case when quality = 1 then 'segment' else 'terminal' end as kind, case when toxic = 1 then 'n' when doc_id % 3 = 0 then 'u' else 'y' end as label from labels),
 y as (select kind, label from x union all select 'all', label from x)
 select kind, count(*) as n, round_even(100 * count(*) filter (where label = 'y') / count(*), 1) as yes, round_even(100 * count(*) filter (where label = 'n') / count(*), 1) as no,
 round_even(100 * count(*) filter (where label = 'u') / count(*), 1) as unsure from y group by kind""")
def q44_label_rates(spark, sf):
    kind = F.when(F.col("quality") == 1, "segment").otherwise("terminal")
    said = F.when(F.col("toxic") == 1, " No, it isn't").when(F.col("doc_id") % 3 == 0, "perhaps").otherwise("YES")
    return metrics.label_rates(A.table(spark, sf, "labels").select(kind.alias("kind"), metrics.judged(said).alias("label")))


@query(f"""with recursive {O.AUDIT}, b as (select sample_id as g, failure_mode as m0, is_answerable as a0,
   case when failure_mode = 'broken_terminal' and sample_id % 3 = 0 then 'connected' else failure_mode end as m1, sample_id % 3 as ne from rep where is_repairable),
 c as (select *, case when m1 = 'connected' then true else a0 end as a1 from b),
 x as (select unnest(list_filter(['attempted', case when not a0 and a1 then 'flipped' end, case when a0 = a1 then 'unchanged' end, case when ne = 0 then 'no_facts' end, m0 || ' -> ' || m1,
   case when not a1 then 'still:' || case when ne = 0 then 'no_facts' else m1 end end], lambda v: v is not null)) as measure from c)
 select measure, count(*) as n from x group by measure""")
def q45_repair_transitions(spark, sf):
    r = _audited(spark, sf)[2].filter("is_repairable").withColumnRenamed("sample_id", "graph_id")
    fixed = (F.col("failure_mode") == "broken_terminal") & (F.col("graph_id") % 3 == 0)
    after = r.withColumn("is_answerable", F.col("is_answerable") | fixed).withColumn("failure_mode", F.when(fixed, "connected").otherwise(F.col("failure_mode")))
    return metrics.repair_outcomes(r, after, r.select("graph_id", (F.col("graph_id") % 3).alias("new_edges")))


@query(f"""with {O.NAMES}, h as (select norm, count(distinct node) as c, min(node) as hit from res group by norm)
 select norm, case when norm in (select node from n) then norm when c = 1 then hit else norm end as entity from l left join h using (norm)""")
def q46_snap_entities(spark, sf):
    labels, nodes = A.name_labels(spark, sf), A.part_names(spark, sf)
    asked = labels.filter(F.trim("label") != "").withColumn("norm", text.normalize(F.col("label")))
    hits = asked.join(resolve.resolve_entities(labels, nodes), ["graph_id", "norm"]).select("graph_id", "label", "entity_id")
    new = asked.select("graph_id", F.col("label").alias("fact_id"), F.lit(0).alias("pos"), "label")
    out = hypergraph.snapped(new, nodes, hits)
    return out.select(text.normalize(F.col("label")).alias("norm"), "entity").distinct()


@query(f"""with {O.NAMES}, j as (select x.node as added, y.node as waypoint, len(list_intersect(string_split(x.node, ' '), string_split(y.node, ' '))) as i,
   len(list_distinct(list_concat(string_split(x.node, ' '), string_split(y.node, ' ')))) as u from n x, n y where x.node <> y.node)
 select added, waypoint, round(i / u, 9) as score from j where i / u > 0.3""")
def q47_token_jaccard(spark, sf):
    n = A.part_names(spark, sf)
    return resolve.near_misses(n, n).select("added", "waypoint", F.round("score", 9).alias("score"))


@query("""select o_orderkey, case when o_orderkey % 11 = 0 then 'replay_empty' when o_orderstatus = 'F' then 'FIXED_ON_REPLAY' when o_orderkey % 3 = 1 then 'NEAR_MISS'
 when o_orderkey % 2 = 1 then 'OTHER_GAP' else 'DISJOINT' end as verdict from orders""")
def q48_stuck_verdict(spark, sf):
    k = F.col("o_orderkey")
    mode = F.when(F.col("o_orderstatus") == "F", "healed").otherwise("broken_terminal")
    return A.table(spark, sf, "orders").select("o_orderkey", metrics.stuck_verdict(mode, (k % 3 == 1).cast("int"), k % 2, k % 11).alias("verdict"))


@query(f"""with {O.ORDERS} select g as graph_id, ok, case when len(ents) = 2 then ents[1] || ' --[' || replace(rel, '_', ' ') || ']--> ' || ents[2]
 else replace(rel, '_', ' ') || '(' || array_to_string(ents, ', ') || ')' end as fact from e""")
def q49_verbalize(spark, sf):
    return _edges(spark, sf).select("graph_id", F.col("edge_seq.chunk_idx").alias("ok"), text.verbalize(F.col("entities"), F.col("relation")).alias("fact"))


@query(f"""with {O.CHUNKS} select doc_id || '_' || idx as chunk_id,
 md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: '[' || (i - 1) || '] ' || w[i]), chr(10))) as numbered,
 case when idx % 2 = 0 then 'Facts:' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || 'Question: q?' || chr(10) || 'Answer:' else 'Question: q?' || chr(10) || 'Answer:' end as answer_prompt,
 md5('Source: s' || chr(10) || 'Target: t' || chr(10) || case when idx % 2 = 0 then 'Goal: g' || chr(10) else '' end || 'Find facts that link source and target in this passage.' || chr(10) || chr(10)
   || array_to_string(list_transform(range(1, len(w) + 1), lambda i: '[' || (i - 1) || '] ' || w[i]), chr(10))) as repair_prompt from c""")
def q50_prompts(spark, sf):
    c = chunking.sentence_chunks(A.document_articles(A.table(spark, sf, "documents")))
    even = F.col("chunk_idx") % 2 == 0
    known = F.when(even, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    asked = text.repair_prompt(F.col("sentences"), F.lit("s"), F.lit("t"), F.when(even, " g ").otherwise("  "))
    return c.select("chunk_id", F.md5(text.numbered(F.col("sentences"))).alias("numbered"), text.answer_prompt(F.lit("q?"), known).alias("answer_prompt"), F.md5(asked).alias("repair_prompt"))


@query(f"""with recursive {O.AUDIT}, b2 as (
  select bv.g, case when n = 1 then [[0, 1]] when c01 then [[1, 2]] when c02 then [[0, 1]] when c12 then [[0, 1]] else [[0, 1], [1, 2]] end as gaps, bv.breaks, bv.pos
  from bv join best on best.g = bv.g and best.pos = bv.pos where bv.breaks > 0),
 gp as (select g, unnest(gaps) as gap from b2),
 sg as (select sm.g, 'segment' as kind, case when gap[1] = 0 then array_to_string(asked, '|') else titles[gap[1]] end as src, titles[gap[2]] as dst from gp join sm using (g)),
 tm as (select sm.g, 'terminal' as kind, titles[len(titles)] as src, sm.answer as dst from best join sm using (g) where best.status = 'entity_unreached' and sm.kind = 'bridge' and len(asked) > 0 and sm.g in (select g from has where found))
 select g as graph_id, kind, src, dst from sg union select * from tm where lower(src) <> lower(dst)""")
def q51_repair_targets(spark, sf):
    samples, _, reports, chains = _audited(spark, sf)
    found = reports.filter("hop_type = 'bridge' and failure_mode not in ('no_question_entities', 'src_unresolved')").select(F.col("sample_id").alias("graph_id"))
    targets = repair.repair_targets(samples, chains.join(found, "graph_id", "left_semi"))
    return targets.select("graph_id", "kind", F.array_join("src_options", "|").alias("src"), F.array_join("dst_options", "|").alias("dst"))


# --- whole flows, held against fixtures in the tests ---------------------------------------------


@query()
def q52_extracted_graph(spark, sf):
    """Chunks of documents through the offline extractor, validation and the hypergraph, to a summary a document."""
    chunks = chunking.sentence_chunks(A.document_articles(A.table(spark, sf, "documents")))
    edges, _ = flows.extracted_edges(chunks, facts.RuleExtractor())
    return hypergraph.graph_summary(edges)


@query()
def q53_repair_attempts(spark, sf):
    """Every repairable sample's targets, with what asking again found."""
    samples, graph, reports, chains = _audited(spark, sf)
    broken = reports.filter("is_repairable").select(F.col("sample_id").alias("graph_id"))
    own, lines = samples.join(broken, "graph_id", "left_semi"), chains.join(broken, "graph_id", "left_semi")
    return flows.repaired(own, graph, lines, facts.RuleExtractor())[0]


@query()
def q54_shortest_paths(spark, sf):
    """A shortest path between the least and the greatest node of each graph."""
    e = _edges(spark, sf)
    ends = hypergraph.incidence(e).groupBy("graph_id").agg(F.min("entity_id").alias("src"), F.max("entity_id").alias("dst"))
    return components.shortest_paths(projection.pairs(e), ends)


@query("select page_id, replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from pages")
def q55_unescaped_titles(spark, sf):
    """Markup signs of page titles as characters."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return A.table(spark, sf, "pages").select("page_id", chunking.unescape_markup(title).alias("title"))


def _scored(spark, sf):
    chunks = A.order_chunks(spark, sf)
    e = A.order_edges(chunks)
    return chunks, e, retrieve.scored_edges(A.audit_samples(spark, sf, chunks), e)


@query()
def q56_graph_evidence(spark, sf):
    _, e, scored = _scored(spark, sf)
    return retrieve.graph_evidence(scored, retrieve.khop_edges(_starts(e), hypergraph.incidence(e)))


@query()
def q57_guided_evidence(spark, sf):
    _, e, scored = _scored(spark, sf)
    return retrieve.guided_evidence(scored, _starts(e), least=0.0)


@query()
def q58_contexts(spark, sf):
    """Facts by condition: none, sentences by similarity, a neighbourhood, a guided walk."""
    chunks, e, scored = _scored(spark, sf)
    samples = A.audit_samples(spark, sf, chunks)
    near = retrieve.khop_edges(_starts(e), hypergraph.incidence(e))
    return retrieve.contexts(samples, {
        "text_rag": retrieve.text_evidence(samples, chunks), "graph": retrieve.graph_evidence(scored, near), "graph_guided": retrieve.guided_evidence(scored, _starts(e)),
    })


@query(f"""with {O.ANSWERS} select condition, count(*) filter (where n_facts < 6) as n_short, round_even(avg(n_facts), 4) as avg_facts,
 round_even(100 * avg(em) filter (where n_facts < 6), 2) as em_short, round_even(100 * avg(em) filter (where n_facts >= 6), 2) as em_full
 from sc where starts_with(condition, 'graph') group by condition""")
def q59_short_budgets(spark, sf):
    return metrics.short_budgets(metrics.scored_answers(A.answers(spark, sf)), k=6)


@query(f"""with recursive {O.AUDIT}, x as (select sm.g, titles[len(titles)] as title from sm),
 b as (select x.g, tn.node from x join tn on tn.g = x.g and tn.title = x.title), nr as (select distinct an.g, w.dst as node from an join both_ways w on w.g = an.g and w.src = an.node),
 k as (select coalesce(p.g, q.g) as graph_id, coalesce(p.c, 0) as answers, coalesce(q.c, 0) as title_nodes from (select g, count(*) as c from an group by g) p full join (select g, count(*) as c from b group by g) q on p.g = q.g)
 select graph_id, answers, title_nodes, (select count(*) from an join b using (g, node) where an.g = graph_id) as shared, (select count(*) from nr join b using (g, node) where nr.g = graph_id) as near from k""")
def q60_self_loop_diagnosis(spark, sf):
    chunks = A.order_chunks(spark, sf)
    graph = flows.graph_of(A.order_edges(chunks), chunks)
    samples = A.audit_samples(spark, sf, chunks)
    last = samples.select("graph_id", F.element_at(F.transform("gold", lambda g: g["title"]), -1).alias("title"))
    a = resolve.resolve_entities(samples.select("graph_id", F.col("answer").alias("label")), graph.nodes)
    return metrics.self_loop_diagnosis(a, resolve.resolve_titles(last, graph.nodes, graph.provenance()), graph.neighbours())


@query(f"with recursive {O.AUDIT} select hop_type, count(*) as n, round_even(100 * count(*) / sum(count(*)) over (), 1) as percent from rep group by hop_type")
def q61_hop_types(spark, sf):
    return metrics.hop_types(A.audit_samples(spark, sf, A.order_chunks(spark, sf)))


@query(f"with recursive {O.AUDIT} select count(*) filter (where text_grounded and failure_mode <> 'connected') as n from rep")
def q62_grounded_not_connected(spark, sf):
    return metrics.grounded_not_connected(_audited(spark, sf)[2])


@query(f"with {O.ORDERS} select distinct inc.g as graph_id, inc.node as entity_id, e.ok, e.rel as relation, len(e.ents) as arity from inc join e on e.g = inc.g and e.ok = inc.ok")
def q63_edges_for_entity(spark, sf):
    e = _edges(spark, sf)
    own = hypergraph.edges_for_entity(hypergraph.incidence(e), e)
    return own.select("graph_id", "entity_id", F.col("edge_seq.chunk_idx").alias("ok"), "relation", F.size("entities").cast("long").alias("arity"))


@query(f"""with {O.ORDERS}, r as (select g, avg(case when list_has_any(string_split(rel, '_'), string_split(case when ok % 2 = 0 then rel else 'nothing' end, ' ')) then 0.0 else 1.0 end) as rate from e group by g)
 select round(avg(rate), 9) as mean_rate, count(*) as graphs from r""")
def q64_corpus_contamination(spark, sf):
    e = _edges(spark, sf)
    said = F.concat(F.lit("("), F.when(F.col("edge_seq.chunk_idx") % 2 == 0, F.col("relation")).otherwise("nothing"), F.lit(")"))
    out = metrics.corpus_contamination(metrics.contamination(e.withColumn("sentence", said)))
    return out.withColumn("mean_rate", F.round("mean_rate", 9))


@query("select doc_id, quality from labels order by md5('0:' || doc_id), doc_id limit 30")
def q65_fixed_sample(spark, sf):
    return metrics.fixed_sample(A.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query(f"""with {O.NATIONS}, d as (
  select x.g, x.ok, x.i, y.i as j, x.node as a, y.node as b from inc x join inc y on x.g = y.g and x.ok = y.ok and x.i < y.i and x.node <> y.node),
 f as (select g, ok, node, min(i) as i from inc group by all), p as (select distinct x.g, x.ok, x.node as src, y.node as dst from f x join f y on x.g = y.g and x.ok = y.ok and x.i < y.i)
 select p.g as graph_id, src, dst, count(*) as n_edges, bool_or(gold) as is_gold from p join e on e.g = p.g and e.ok = p.ok group by all""")
def q66_directed_pairs(spark, sf):
    p = projection.pairs(A.nation_edges(spark, sf), directed=True)
    return p.select("graph_id", "src", "dst", F.size("edge_ids").cast("long").alias("n_edges"), "is_gold")


@query(r"""with f as (select doc_id, regexp_extract_all(text, '(?:[A-Z]|[^\x00-\x7F\P{L}]|[\p{No}\p{Nl}])[\p{L}\p{N}_\x27-]*(?:[\s\x0B\x1C-\x1F\x{85}\p{Z}]+(?:[A-Z]|[^\x00-\x7F\P{L}]|[\p{No}\p{Nl}])[\p{L}\p{N}_\x27-]*)*') as s from (select doc_id, coalesce(text, '') as text from documents))
 select doc_id as graph_id, array_to_string(list_filter(s, lambda x: regexp_matches(x, '^\p{Lu}')), chr(10)) as entities from f""")
def q67_question_entities(spark, sf):
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("graph_id"), F.col("text").alias("question"))
    own = facts.question_entities(docs, facts.RuleExtractor())
    return own.select("graph_id", F.array_join("entities", "\n").alias("entities"))


@query(f"with w as (select ['{"','".join(r for _, r in _RAW)}'][o_orderkey % 14 + 1] as reason from orders) select case when reason = 'valid' then 'valid' else 'rejected:' || reason end as measure, count(*) as n from w group by 1")
def q68_extractor_stats(spark, sf):
    fact = F.get(F.array(*(F.lit(f) for f, _ in _RAW)), (F.col("o_orderkey") % 14).cast("int"))
    sentences = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    rows = A.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat(F.lit("["), fact, F.lit("]")).alias("raw"), sentences.alias("sentences"))
    return facts.extractor_stats(facts.checked_facts(rows))


@query()
def q69_repair_actions(spark, sf):
    """Agent calls with both kinds of refusal, and the chunks that sound ones read."""
    chunks = A.order_chunks(spark, sf)
    graph = flows.graph_of(A.order_edges(chunks), chunks)
    src = F.when(F.col("graph_id") % 5 == 0, " ").when(F.col("graph_id") % 5 == 1, "nobody").otherwise(F.col("entity_id"))
    calls = _starts(graph.edges).select("graph_id", F.lit(0).alias("target_pos"), src.alias("src"), F.lit("anyone").alias("dst"))
    names = resolve.resolve_entities(calls.select("graph_id", F.col("src").alias("label")), graph.nodes)
    return repair.repair_actions(calls, names, graph.places, graph.chunks)


@query(f"""with {O.ORDERS}, s as (select g, min(node) as node from nodes group by g), m as (
  select distinct s.g, inc.ok from s join inc on inc.g = s.g and inc.node = s.node),
 r as (select *, row_number() over (partition by g order by ok) as n from m) select g as graph_id, ok from r where n <= 3""")
def q70_source_chunks(spark, sf):
    """Up to three chunks, in sample order, that mention a graph's least node."""
    chunks = A.order_chunks(spark, sf)
    graph = flows.graph_of(A.order_edges(chunks), chunks)
    ends = _starts(graph.edges).select("graph_id", F.lit(0).alias("target_pos"), F.col("entity_id").alias("src"), F.lit("none").alias("dst"))
    names = resolve.resolve_entities(ends.select("graph_id", F.col("src").alias("label")), graph.nodes)
    return repair.source_chunks(ends, names, graph.places, graph.chunks).select("graph_id", F.col("chunk_idx").alias("ok"))


@query("select cast(sum(l_linenumber - 1) as bigint) as new_edges, count(*) filter (where l_linenumber > 1) as samples from lineitem")
def q71_repair_totals(spark, sf):
    return metrics.repair_totals(A.table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("new_edges")))


@query(f"with {O.ORDERS}, x as (select distinct inc.node from inc) select count(*) as known, (select count(*) from part) - count(*) as unknown from x")
def q72_known_names(spark, sf):
    """Parts that are nodes of some graph, and those that aren't: semi and anti join of labels and nodes."""
    nodes = hypergraph.incidence(_edges(spark, sf)).select("entity_id").distinct()
    parts = A.table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"))
    known = parts.join(nodes, "entity_id", "left_semi").agg(F.count("*").alias("known"))
    return known.join(F.broadcast(parts.join(nodes, "entity_id", "left_anti").agg(F.count("*").alias("unknown"))))


@query(f"""with recursive {O.ORDERS}, starts as (select g, min(node) as source from nodes group by g), {O.WALKS},
 t as (select g, max(node) as node from nodes group by g),
 k(g, node, h) as (select d.g, d.node, d.h from d join t using (g, node) union all select k.g, pv.prev, k.h - 1 from k join pv on pv.g = k.g and pv.node = k.node where k.h > 0),
 bo as (select pp.g, src, dst, pp.ok, row_number() over (partition by pp.g, src, dst order by gold desc, len(ents) desc, pp.ok) as n from pp join e on e.g = pp.g and e.ok = pp.ok)
 select y.g as graph_id, y.h as pos, x.node as from_node, y.node as to_node, bo.ok
 from k x join k y on y.g = x.g and y.h = x.h + 1 join bo on bo.g = y.g and bo.src = least(x.node, y.node) and bo.dst = greatest(x.node, y.node) and bo.n = 1""")
def q73_path_edges(spark, sf):
    """The path from the least to the greatest node of each graph, with the edge to show for each hop."""
    dealt = A.order_edges(A.order_chunks(spark, sf).repartition("graph_id"))
    e = flows.stored(dealt.select("graph_id", "edge_id", "edge_seq", "is_gold", "entities"))
    ends = e.groupBy("graph_id").agg(F.min(F.array_min("entities")).alias("src"), F.max(F.array_max("entities")).alias("dst"))
    return flows.shown_paths(e, ends).select("graph_id", "pos", "from_node", "to_node", F.col("edge_seq.chunk_idx").alias("ok"))


@query(f"""with recursive {O.ORDERS}, fl as (select g, min(ok) as a, max(ok) as b from e group by g), starts as (select distinct fl.g, node as source from fl join inc on inc.g = fl.g and inc.ok = fl.a),
 {O.WALKS}, t as (select distinct fl.g, node from fl join inc on inc.g = fl.g and inc.ok = fl.b),
 r as (select d.g, d.source, d.node, d.h, row_number() over (partition by d.g order by d.h, d.source, d.node) as n from d join t using (g, node) where d.source <> d.node)
 select g as graph_id, source as src, node as dst, h as hops from r where n = 1""")
def q74_best_path_between_sets(spark, sf):
    """The shortest path from a node of each graph's first edge to another of its last."""
    e = _edges(spark, sf)
    own = e.groupBy("graph_id").agg(F.min_by("entities", "edge_seq").alias("from"), F.max_by("entities", "edge_seq").alias("to"))
    sets = own.select("graph_id", F.lit(0).alias("set_id"), F.explode(F.create_map(F.lit("from"), F.col("from"), F.lit("to"), F.col("to"))).alias("side", "nodes"))
    sets = sets.select("graph_id", "set_id", "side", F.explode("nodes").alias("node"))
    return components.best_ends(projection.pairs(e), sets).drop("set_id")


@query(f"""with {O.ANSWERS}, x as (select *, ['{"','".join(audit.SEVERITY)}'][conv_id % {len(audit.SEVERITY)} + 1] as failure_mode from sc)
 select condition, failure_mode, count(*) as n, {_percents('em', 'f1')} from x group by all""")
def q75_em_f1_by_failure_mode(spark, sf):
    modes = F.array(*(F.lit(m) for m in audit.SEVERITY))
    own = A.answers(spark, sf).withColumn("failure_mode", F.get(modes, F.pmod("conv_id", F.lit(len(audit.SEVERITY))).cast("int")))
    return metrics.by_condition(metrics.scored_answers(own), "failure_mode")


@query()
def q76_repaired_contexts(spark, sf):
    """Facts of the neighbourhood and of the guided walk once more, on the graphs with the edges that repair found."""
    samples, graph, reports, chains = _audited(spark, sf)
    broken = reports.filter("is_repairable").select(F.col("sample_id").alias("graph_id"))
    own, lines = samples.join(broken, "graph_id", "left_semi"), chains.join(broken, "graph_id", "left_semi")
    found = flows.repaired(own, graph, lines, facts.RuleExtractor())[1]
    edges = found.select("graph_id", "edge_id", "edge_seq", "sentence", "entities")
    starts = flows.stored(edges.groupBy("graph_id").agg(F.min(F.array_min("entities")).alias("entity_id")))
    scored, near = flows.scored_walks(samples, edges, starts)
    return retrieve.contexts(samples, {"graph_repair": retrieve.graph_evidence(scored, near), "graph_guided_repair": retrieve.guided_evidence(scored, starts)})


@query(f"""with {O.ORDERS}, x as (select g, ok, row_number() over (partition by g order by ok) as n from e where ok % 3 > 0) select g as graph_id, ok from x where n <= {repair.MAX_EDGES}""")
def q77_new_edges_of_an_action(spark, sf):
    """What one repair action may add to a graph: edges it doesn't have yet, in order, up to the limit of the action."""
    e = _edges(spark, sf)
    before = e.filter(F.col("edge_seq.chunk_idx") % 3 == 0)
    found = e.withColumn("entities", F.reverse("entities"))  # listed another way, an edge is the same
    added = repair.new_edges(found, before, most_per_graph=repair.MAX_EDGES)
    return added.select("graph_id", F.col("edge_seq.chunk_idx").alias("ok"))


@query("select doc_id, case when turn = 0 then 'none' else 'line ' || turn end as answer, regexp_replace('a/b:' || doc_id, '[^A-Za-z0-9_-]', '_', 'g') as file from labels, (select unnest(range(0, 3)) as turn)")
def q78_first_lines(spark, sf):
    """The first line of a response, and chunk ids as file names."""
    rows = A.table(spark, sf, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn"))
    said = F.when(F.col("turn") == 0, F.lit(" none\nbecause")).otherwise(F.concat(F.lit("\n line "), F.col("turn").cast("string"), F.lit(" \nand more")))
    return rows.select("doc_id", text.first_line(said).alias("answer"), text.file_name(F.concat(F.lit("a/b:"), F.col("doc_id").cast("string"))).alias("file"))
