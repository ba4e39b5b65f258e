"""Benchmark decontamination with a broadcast set of test n-grams. DataFrame functions only.

A benchmark item's windows are its runs of `n` words. The hashes of their first
words and of the whole set bits of two filters, sized by the number of windows
and shipped as literals of a few MB at most; the scan of a document hashes the
first words at each place and, where they pass, the whole window. Only windows
that pass, a fraction of a per cent besides true ones, leave the row, and are
verified by a join on the words themselves. The windows are broadcast when they
are few and joined by a shuffle otherwise. A benchmark of millions of windows
fills the filters; more places then leave the rows, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, if_small, table, text_of, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: As WORD, before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of a filter, as powers of two: at least, and at most (4 MB); bits for each window, and how many of them it sets.
LEAST_BITS, MOST_BITS, WINDOW_BITS, PROBES = 18, 25, 48, 3
#: Words at a window's start that are looked up before the whole.
HEAD = 3


def words_of(name: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(text_of(name)), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(window, length, items): distinct windows of all items, words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of().alias("words"))
    items = items.withColumn("length", F.least(F.size("words"), F.lit(n))).filter("length > 0")
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at")
    windows = items.select("item", "length", "words", starts)
    windows = windows.select("item", "length", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window"))
    return windows.groupBy("window", "length").agg(F.collect_set("item").alias("items"))


def _probe(hashed: Column, k: int, bits: int) -> Column:
    """The k-th of a window's places in a filter of 2^bits bits."""
    return F.shiftrightunsigned(hashed, 19 * k).bitwiseAND(F.lit((1 << bits) - 1))


def _filter_of(hashes: DataFrame, probes: int) -> tuple[Column, int]:
    """The filter of a column h of hashes, as a literal array of 64-bit words, and its bits as a power of two."""
    bits = min(MOST_BITS, max(LEAST_BITS, (WINDOW_BITS * hashes.count()).bit_length()))
    places = hashes.select(F.explode(F.array(*(_probe(F.col("h"), k, bits) for k in range(probes)))).alias("bit"))
    rows = places.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("set")
    )
    out = [0] * (1 << bits >> 6)
    for word, bits_set in rows.collect():  # as many words as the filter has
        out[word] = bits_set
    return F.from_json(F.lit(str(out)), "array<long>"), bits  # folded to a literal when the plan is made


def _passes(hashed: Column, literal: tuple[Column, int], probes: int) -> Column:
    out = F.lit(True)
    for k in range(probes):
        bit = _probe(hashed, k, literal[1])
        word = F.get(literal[0], F.shiftright(bit, 6).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _head(words: Column, at: Column, length: int) -> Column:
    """Hash of the first words of the window at `at`, from 1."""
    return F.xxhash64(*(F.get(words, at + (k - 1)) for k in range(min(HEAD, length))))


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """`keep` columns and n_words of each row, and per verified window its start, length and items."""
    windows = cut(benchmark_windows(benchmark, n))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    split = windows.withColumn("words", F.split("window", " "))
    whole = _filter_of(split.select(F.xxhash64("words").alias("h")), PROBES)
    heads = {k: _filter_of(split.filter(F.col("length") == k).select(_head(F.col("words"), F.lit(1), k).alias("h")), 1) for k in lengths}

    def found(length: int) -> Column:
        last = F.size("words") - length + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        own = F.filter(
            starts,
            lambda i: _passes(_head(F.col("words"), i, length), heads[length], 1)
            & _passes(F.xxhash64(F.slice("words", i, length)), whole, PROBES),
        )
        return F.transform(
            own,
            lambda i: F.struct(
                i.alias("at"), F.lit(length).alias("long"), F.array_join(F.slice("words", i, length), " ").alias("has")
            ),
        )

    scan = docs.select(*keep, F.monotonically_increasing_id().alias("row"), words_of().alias("words"))
    hits = F.concat(*map(found, lengths)) if lengths else F.expr("cast(array() as array<struct<at:int,long:int,has:string>>)")
    # rows are told apart by their number, which must stay the same when a lost executor's work is done again
    scan = cut(scan.select(*keep, "row", F.size("words").cast("long").alias("n_words"), hits.alias("hits")))
    scan = scan.select(*keep, "row", "n_words", F.explode_outer("hits").alias("hit"))
    scan = scan.select(*keep, "row", "n_words", "hit.at", "hit.long", "hit.has")
    return scan.join(if_small(windows.select("window", "items")), F.col("has") == F.col("window"), "left")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`.

    A document word inside any occurrence of an item's window is hit; an item of
    fewer than `n` words, but not none, is one window. Null texts have no words.
    Rows repeated with one doc_id are judged apart. Items without an id mark
    words but aren't counted. Without items, or documents, nothing is hit.
    """
    hit = F.when(F.col("window").isNotNull(), F.struct("at", "long"))
    grouped = _scanned(docs, benchmark, n, ["doc_id"]).groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return grouped.select(
        "doc_id",
        "n_words",
        _covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _covered(hits: Column) -> Column:
    """Words in the union of (at, long), sorted."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))

    def add(state: Column, hit: Column) -> Column:
        end = hit["at"] + hit["long"]
        fresh = F.greatest(F.lit(0), end - F.greatest(hit["at"], state["end"]))
        return F.struct((state["words"] + fresh).alias("words"), F.greatest(end, state["end"]).alias("end"))

    return F.aggregate(hits, start, add, lambda state: state["words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """`docs`, all columns, without the contaminated rows (remove="documents") or words (remove="spans").

    With "spans", each hit word goes and what stands between words stays.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    digest = F.sha2(text_of(), 256)
    plain = docs.select("doc_id", "text", digest.alias("digest"))
    hits = _scanned(plain, benchmark, n, ["doc_id", "digest"]).filter("window is not null")
    hits = cut(
        hits.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("at", "long"))).alias("hits"))
        .select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "hits")
    )
    own = unused(docs, "_digest")
    named = docs.withColumn(own, digest)
    same = named["doc_id"].eqNullSafe(hits["hit_id"]) & (named[own] == hits["hit_digest"])
    if remove == "documents":
        return named.join(if_small(hits.select("hit_id", "hit_digest")), same, "left_anti").drop(own)
    marks = unused(docs, "_hits")
    found = hits.withColumnRenamed("hits", marks)
    joined = named.join(if_small(found), same, "left")
    words = F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0))
    gaps = F.split("text", RAW_WORD)
    inside = lambda i: F.exists(marks, lambda h: (h["at"] <= i + 1) & (i + 1 < h["at"] + h["long"]))
    left = F.transform(words, lambda w, i: F.when(inside(i), F.lit("")).otherwise(w))
    text = F.array_join(F.zip_with(gaps, left, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit("")))), "")
    columns = [F.when(F.col(marks).isNull(), F.col("text")).otherwise(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bw as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, cast(len(w) - least(10, len(w)) + 2 as bigint))) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, cast(len(w) - n + 2 as bigint))) as i from d, lens where len(w) >= n)),
h as (select distinct doc_id, item, i, dw.n from dw join bw using (n, win)),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""
