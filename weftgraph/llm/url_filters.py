"""URL filters by a sort-merge range join.

A host is written with its labels reversed and each ended by a dot, so that the
subdomains of a host are exactly the keys that begin with the host's key: a
rule's host is an interval of keys, and the intervals of two rules are nested
or apart. Rules and urls go together into ranges of keys, sorted; urls are also
ordered by path and a hash of their row, so that a host, or a url, that holds a
third of all rows is split over ranges. A sweep over each range keeps a stack of
the rules whose interval holds the current key and judges the url's path
against those alone. A range begins with the rules that enclose its first key,
found by a join of the label prefixes of the ranges' first keys with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
RESULT = "page_id long, host string, path string, rule string, verdict string"


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def prefixes(key: Column) -> Column:
    """Keys of a key's host and of all hosts that enclose it."""
    labels = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null, or without `://`: both are empty."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(there > 0, F.substr(url, there + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    return ascii_lower(host), F.regexp_extract(after, r"^[^?#]*", 0)


class Sweep:
    """A sweep in the order of keys, with the stack of the rules whose interval holds the current key."""

    def __init__(self, around: list[tuple[str, str, str, str]] = ()):
        """around: (key, path, rule, verdict) of the rules that enclose the first key, outermost first."""
        self.stack = list(around)

    def to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.to(key)
        self.stack.append((key, path, rule, verdict))

    def url(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits and its verdict."""
        self.to(key)
        fit = [r for r in self.stack if path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[2]), len(r[0]), r[2]), default=None)
        return (best[2], best[3]) if best else (None, None)


def _rules(spark, rules) -> DataFrame:
    """(key, path, rule, verdict) from a table or tuples of (verdict, host, path)."""
    own = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return own.select(reversed_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict").distinct()


def url_filter(pages: DataFrame, rules=RULES, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages`.

    rules: (verdict, host, path), as tuples or a table of any size. A rule fits
    its host and all subdomains if the url's path begins with the rule's path;
    of those that fit, the one whose text (host and path) is longest wins, then
    the one with the longer host. Urls that no rule fits get a null rule and
    `default`. A null url, or one without `://`, has an empty host and path.
    Only page_id and url are read; repeated rows are each judged, rows without a
    page_id too; an empty table gives an empty result. The rules that enclose one
    host have place in memory.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_key(F.col("host")))
    end = F.lit("\0")
    spread = F.hex(F.xxhash64("page_id", "host", "path"))
    no = lambda kind: F.lit(None).cast(kind)
    own = cut(_rules(spark, rules))
    met = own.select(F.col("key").alias("place"), "key", "path", "rule", "verdict", no("long").alias("page_id"), no("string").alias("host")).unionByName(
        urls.select(
            F.concat("key", end, "path", end, spread).alias("place"), "key", "path", no("string").alias("rule"), no("string").alias("verdict"), "page_id", "host"
        )
    )
    dealt = met.repartitionByRange(ranges, "place") if ranges else met.repartitionByRange("place")
    # a rule's place is its key, which comes before those of the urls and rules it encloses
    dealt = cut(dealt.sortWithinPartitions("place", "path", "rule", "verdict"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [pdf["key"].iloc[0]], "at": [pdf["place"].iloc[0]]})
                return

    firsts = dealt.select("key", "place").mapInPandas(first, "part int, first string, at string")
    # a rule at the range's first place, or behind it, is in the range itself or in one before
    wanted = firsts.select("part", "at", F.explode(prefixes(F.col("first"))).alias("prefix"))
    around = wanted.join(own, F.col("prefix") == F.col("key")).filter(F.col("key") < F.col("at"))
    enclosing: dict[int, list[tuple]] = {}
    # the rules on the stack where a range begins: as many as enclose one host, for each range
    for row in around.select("part", "key", "path", "rule", "verdict").collect():
        enclosing.setdefault(row["part"], []).append(tuple(row)[1:])
    shared = spark.sparkContext.broadcast({part: sorted(rows) for part, rows in enclosing.items()})

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Sweep(shared.value.get(TaskContext.get().partitionId(), ()))
        for pdf in batches:
            is_url = pdf["host"].notna()
            found = []
            for key, path, rule, verdict, url in zip(pdf["key"], pdf["path"], pdf["rule"], pdf["verdict"], is_url, strict=True):
                if url:
                    found.append(state.url(key, path))
                else:
                    state.rule(key, path, rule, verdict)
            if found:
                own = pdf.loc[is_url, ["page_id", "host", "path"]].astype({"page_id": "Int64"})
                yield own.assign(rule=[f[0] for f in found], verdict=[f[1] or default for f in found])

    return dealt.mapInPandas(sweep, RESULT)


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


ORACLE = r"""
with p as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from p),
u as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
  from h),
r(verdict, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f as (
  select page_id, max_by({'rule': rhost || rpath, 'verdict': verdict}, length(rhost || rpath)) as best
  from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id)
select u.page_id, u.host, u.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from u left join f using (page_id)
"""
