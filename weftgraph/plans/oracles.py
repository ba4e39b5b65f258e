"""The same results in SQL, written apart from the operators."""

from __future__ import annotations

CHUNKS = """
a as (select doc_id, source, string_split(coalesce(text, ''), '. ') as s from documents),
c as (
  select doc_id, source, st, s[st + 1 : st + 5] as w,
         row_number() over (partition by doc_id order by st) - 1 as idx
  from (select doc_id, source, s, unnest(range(0, len(s), 4)) as st from a))"""

ORDERS = """
li as (
  select o_custkey as g, o_orderkey as ok, o_orderpriority as pr, o_orderstatus as st,
         list('part:' || l_partkey order by l_linenumber, l_partkey) as ents
  from orders join lineitem on l_orderkey = o_orderkey group by all),
e as (
  select g, ok, pr, st = 'F' as gold, ents, lower(pr) as rel from li
  where len(ents) <= 6 and len(list_distinct(ents)) >= 2),
inc as (select g, ok, i, ents[i] as node from (select g, ok, ents, unnest(range(1, len(ents) + 1)) as i from e)),
nodes as (select distinct g, node from inc),
pp as (
  select distinct x.g, x.ok, least(x.node, y.node) as src, greatest(x.node, y.node) as dst
  from inc x join inc y on x.g = y.g and x.ok = y.ok and x.node < y.node),
pairs as (select distinct g, src, dst from pp),
both_ways as (select g, src, dst from pairs union all select g, dst, src from pairs)"""

NATIONS = """
li as (
  select c_nationkey as g, o_orderkey as ok, o_orderstatus as st, o_orderpriority as pr,
         list('supp:' || l_suppkey order by l_linenumber, l_suppkey) as ents
  from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey group by all),
e as (
  select g, ok, st = 'F' as gold, ents, lower(pr) as rel from li
  where len(ents) <= 6 and len(list_distinct(ents)) >= 2),
inc as (select g, ok, i, ents[i] as node from (select g, ok, ents, unnest(range(1, len(ents) + 1)) as i from e)),
pp as (
  select distinct x.g, x.ok, least(x.node, y.node) as src, greatest(x.node, y.node) as dst
  from inc x join inc y on x.g = y.g and x.ok = y.ok and x.node < y.node)"""

PARTS = """
r(g, node, root) as (
  select g, node, node from nodes
  union
  select r.g, b.dst, r.root from r join both_ways b on b.g = r.g and b.src = r.node),
parts as (select g, node, min(root) as comp from r group by g, node)"""

LINES = """
f as (
  select o_custkey % 100 as g, o_custkey as chunk, o_orderkey as ok, l_linenumber as ln, lower(l_returnflag) as rel,
         'part ' || (l_partkey % 4) as a, 'supp ' || (l_suppkey % 3) as b, l_orderkey % 3 = 0 as turned,
         l_linenumber % 3 as si, o_orderstatus = 'F' as fin
  from orders join lineitem on l_orderkey = o_orderkey),
d as (
  select *, row_number() over (partition by g, chunk, rel, a, b order by ok, ln) as k from f),
k as (select * from d where k = 1)"""

NAMES = """
n as (select distinct lower(p_name) as node from part),
l as (
  select distinct trim(lower(label)) as norm from (
    select upper(node) as label from n
    union all select array_to_string(list_reverse(string_split(node, ' ')), ' ') || ' deluxe' from n
    union all select string_split(node, ' ')[1] from n
    union all select 'zzz' union all select ' ')
  where trim(label) <> ''),
exact as (select norm, node, 1 as tier from l join n on norm = node),
subset as (
  select norm, node, 2 as tier from l, n
  where norm not in (select norm from exact) and length(norm) >= 4 and length(node) >= 4
    and (list_has_all(string_split(norm, ' '), string_split(node, ' ')) or list_has_all(string_split(node, ' '), string_split(norm, ' ')))),
res as (select * from exact union all select * from subset)"""

ANSWERS = r"""
u as (select conv_id, turn, text as short, lead(text) over (partition by conv_id order by turn, text) as nxt from conversations),
p as (
  select conv_id, turn, ['closed_book', 'text_rag', 'graph', 'graph_repair'][conv_id % 4 + 1] as condition, short as gold,
         case when turn % 3 = 0 then 'The ' || upper(replace(short, 'ß', 'ss')) || '!' else nxt end as pred,
         cast(case when conv_id % 4 = 0 then 0 else 4 + turn % 5 end as integer) as n_facts, turn % 2 = 0 as answerable
  from u where nxt is not null),
tok as (
  select *, list_filter(regexp_split_to_array(regexp_replace(lower(gold), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x not in ('', 'a', 'an', 'the')) as gt,
         list_filter(regexp_split_to_array(regexp_replace(lower(pred), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x not in ('', 'a', 'an', 'the')) as pt
  from p),
rn as (select *, row_number() over () as rn from tok),
gc as (select rn, w, count(*) as c from (select rn, unnest(gt) as w from rn) group by all),
pc as (select rn, w, count(*) as c from (select rn, unnest(pt) as w from rn) group by all),
sh as (select rn, sum(least(gc.c, pc.c)) as shared from gc join pc using (rn, w) group by rn),
sc as (
  select * exclude (rn), case when gt = pt then 1.0::double else 0.0::double end as em,
         case when len(gt) = 0 or len(pt) = 0 then case when len(gt) = len(pt) then 1.0::double else 0.0::double end
              else 2.0::double * coalesce(shared, 0) / (len(pt) + len(gt)) end as f1
  from rn left join sh using (rn))"""

AUDIT = (
    ORDERS
    + ","
    + PARTS
    + """,
cu as (
  select g, arg_min(pr, ok) as t1, arg_max(pr, ok) as t2, arg_min(ents[1], ok) as e1, arg_max(ents[len(ents)], ok) as e2,
         max(list_aggregate(list_transform(ents, lambda x: cast(substr(x, 6) as bigint)), 'max')) as most
  from li group by g),
sm as (
  select g, c_mktsegment, case when t1 = t2 then [t1] else [t1, t2] end as titles,
         case when g % 10 = 3 then [] when g % 10 = 4 then ['nowhere', 'unknown thing'] else [e1, e2] end as asked,
         case when g % 7 = 0 then 'yes' when g % 7 = 1 then c_mktsegment when g % 7 = 2 then t1 else 'part:' || most end as answer,
         case when g % 50 = 7 then 'other' when g % 2 = 0 then 'bridge' else 'comparison' end as kind,
         case when g % 11 = 0 then 1 else 0 end as failures
  from cu join customer on c_custkey = g),
tn as (  -- nodes of each title
  select distinct inc.g, e.pr as title, inc.node, parts.comp from inc join e on e.g = inc.g and e.ok = inc.ok
  join parts on parts.g = inc.g and parts.node = inc.node),
an as (select sm.g, parts.node, parts.comp from sm join parts on parts.g = sm.g and parts.node = lower(answer)),
en as (
  select x.g, x.pos, x.name, parts.comp from (select g, unnest(range(1, len(asked) + 1)) as pos, unnest(asked) as name from sm) x
  left join parts on parts.g = x.g and parts.node = x.name),
gr as (
  select g, bool_or(answer <> 'yes' and contains(' ' || array_to_string(ents, ' ') || ' ', ' ' || lower(answer) || ' ')) as grounded
  from li join sm using (g) group by g),
tt as (select g, unnest(range(1, len(titles) + 1)) as tpos, unnest(titles) as title, len(titles) as n from sm),
st as (  -- source to title
  select en.g, en.pos, tt.tpos, bool_or(coalesce(en.comp = tn.comp and en.name <> tn.node, false)) as c
  from en join tt on tt.g = en.g left join tn on tn.g = en.g and tn.title = tt.title group by all),
t12 as (
  select x.g, bool_or(coalesce(a.comp = b.comp and a.node <> b.node, false)) as c
  from (select g, titles from sm where len(titles) = 2) x
  left join tn a on a.g = x.g and a.title = x.titles[1] left join tn b on b.g = x.g and b.title = x.titles[2] group by x.g),
ta as (  -- title to answer
  select tt.g, tt.tpos, count(tn.node) > 0 as some, bool_or(coalesce(tn.node = an.node, false)) as overlap,
         bool_or(coalesce(tn.comp = an.comp and tn.node <> an.node, false)) as c
  from tt left join tn on tn.g = tt.g and tn.title = tt.title left join an on an.g = tt.g group by all),
has as (select sm.g, exists (select 1 from an where an.g = sm.g) as node, exists (select 1 from en where en.g = sm.g and comp is not null) as found from sm),
bc as (  -- candidate chains of bridges
  select sm.g, s1.pos, len(titles) as n, s1.c as c01, coalesce(s2.c, false) as c02, coalesce(t12.c, false) as c12
  from sm join has using (g) join st s1 on s1.g = sm.g and s1.tpos = 1 left join st s2 on s2.g = sm.g and s2.pos = s1.pos and s2.tpos = 2
  left join t12 on t12.g = sm.g where kind = 'bridge' and has.found),
bv as (
  select *, case when n = 1 then case when c01 then 0 else 1 end when c01 then case when c12 then 0 else 1 end when c02 then 1 when c12 then 1 else 2 end as breaks,
         case when n = 2 and not c01 and c02 then 1 else 0 end as heals,
         case when n = 1 then c01 when c01 then c12 else c02 or c12 end as stands, n as tpos, 0 as chain_pos
  from bc),
nb as (  -- entities next to nodes of a title
  select distinct en.g, en.pos, tt.tpos from en join both_ways b on b.g = en.g and b.src = en.name join tt on tt.g = en.g
  join tn on tn.g = en.g and tn.title = tt.title and tn.node = b.dst),
pr1 as (select sm.g, min(nb.tpos) as tp from sm left join nb on nb.g = sm.g and nb.pos = 1 where kind = 'comparison' and len(asked) > 0 group by sm.g),
pr2 as (
  select pr1.g, pr1.tp as tp1, min(nb.tpos) as tp2 from pr1 left join nb on nb.g = pr1.g and nb.pos = 2 and nb.tpos is distinct from pr1.tp group by all),
cc as (  -- comparison chains: a title with the entity it was given
  select tt.g, tt.tpos, case when tp1 = tt.tpos then 1 when tp2 = tt.tpos then 2 end as pos, tt.n
  from tt join pr2 on pr2.g = tt.g join has on has.g = tt.g where has.found),
cv as (
  select cc.g, cc.tpos, cc.tpos - 1 as chain_pos, cc.pos, cc.n, coalesce(st.c, false) as stands, case when st.c then 0 else 1 end as breaks, 0 as heals
  from cc left join st on st.g = cc.g and st.pos = cc.pos and st.tpos = cc.tpos),
early as (
  select sm.g, 0 as chain_pos, 1 as breaks, 0 as heals, false as stands, 0 as tpos, 1 as pos, false as one from sm join has using (g) where not found),
ch as (
  select g, chain_pos, breaks, heals, stands, tpos, pos, false as one from bv
  union all select g, chain_pos, breaks, heals, stands, tpos, coalesce(pos, 0), pos is not null from cv
  union all select * from early),
tv as (
  select ch.*, sm.kind, sm.answer,
         case when answer = 'yes' then 'predicate' when not has.node then 'not_an_entity' when not stands or not coalesce(ta.some, false) then 'entity_unreached'
              when ta.overlap or ta.c then 'entity_reached' else 'entity_unreached' end as status,
         answer <> 'yes' and has.node and stands and coalesce(ta.overlap, false) as trivial, coalesce(gr.grounded, false) as grounded, breaks = heals as linked
  from ch join sm using (g) join has using (g) left join gr using (g) left join ta on ta.g = ch.g and ta.tpos = ch.tpos),
best as (
  select * from (select *, row_number() over (partition by g, chain_pos order by case when linked then heals else 1e9 end, status = 'entity_unreached', trivial, pos) as k from tv) where k = 1),
md as (
  select *, case when not linked then case when status = 'predicate' then 'predicate_broken' else 'broken_mid_chain' end
                 when status = 'entity_unreached' then 'broken_terminal' when status = 'not_an_entity' then 'answer_not_entity'
                 when status = 'predicate' then 'predicate_ok' when heals > 0 then 'healed' else 'connected' end as mode
  from best),
sev(mode, rank) as (
  values ('no_question_entities', 0), ('src_unresolved', 1), ('broken_mid_chain', 2), ('predicate_broken', 3), ('broken_terminal', 4),
         ('answer_not_entity', 5), ('healed', 6), ('predicate_ok', 7), ('connected', 8)),
alone as (
  select pr2.g, 2 - (case when tp1 is null then 0 else 1 end) - (case when tp2 is null then 0 else 1 end) as k
  from pr2 join has using (g) where has.found),
rp as (
  select sm.g, coalesce(bool_and(linked and status <> 'entity_unreached'), false) as answerable, coalesce(bool_and(linked and heals = 0), true) as clean,
         coalesce(bool_or(trivial), false) as trivial, coalesce(bool_or(status = 'entity_reached' and not trivial), false) as genuine,
         coalesce(bool_or(md.grounded), false) as grounded, count(md.g) as n, coalesce(sum(breaks), 0) as breaks, coalesce(sum(case when linked then heals else 0 end), 0) as heals,
         min(rank) as worst, array_to_string(list(status order by chain_pos) filter (where status is not null), ',') as statuses
  from sm left join md on md.g = sm.g left join sev on sev.mode = md.mode group by sm.g),
rep as (
  select sm.g as sample_id, sm.kind as hop_type, sev.mode as failure_mode, rp.answerable as is_answerable, rp.answerable and rp.clean as is_clean,
         sev.mode in ('broken_mid_chain', 'broken_terminal', 'predicate_broken') as is_repairable, array_to_string(asked, ',') as question_entities, sm.answer,
         coalesce(statuses, '') as terminal, rp.trivial as trivial_terminal, rp.genuine as genuine_terminal, rp.grounded as text_grounded,
         cast(rp.n + coalesce(alone.k, 0) as bigint) as num_reasoning_chains, cast(rp.breaks + coalesce(alone.k, 0) as bigint) as total_broken_hops,
         cast(rp.heals as bigint) as num_heals, cast(sm.failures as bigint) as parse_failures, array_to_string(titles, ',') as supporting_titles
  from sm join rp using (g) join has using (g) left join alone using (g)
  join sev on sev.rank = case when len(asked) = 0 then 0 when not has.found then 1 else coalesce(worst, 2) end)"""
)

#: Breadth-first distances of all nodes from the `starts` (g, source), and for each the least node before it.
WALKS = """
w(g, source, node, h) as (
  select g, source, source, 0 from starts
  union
  select w.g, w.source, b.dst, w.h + 1 from w join both_ways b on b.g = w.g and b.src = w.node where w.h < 12),
d as (select g, source, node, min(h) as h from w group by g, source, node),
pv as (
  select d.g, d.source, d.node, min(b.dst) as prev
  from d join both_ways b on b.g = d.g and b.src = d.node join d z on z.g = d.g and z.source = d.source and z.node = b.dst and z.h = d.h - 1
  group by d.g, d.source, d.node)"""
