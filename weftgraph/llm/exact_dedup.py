"""Exact deduplication by an extendible-hash index on shared files. DataFrame functions only.

1. One scan reduces every row to an entry (key, sha, doc_id, row): the 64-bit
   hash of its normalised text is the key. Entries are checkpointed in the
   shared folder; texts aren't moved.
2. Keys with more than one entry are candidates. Their texts fold on the map
   side, so a text held by a third of the rows leaves at most SALTS entries with
   counts, and go into bucket files in the shared folder. A bucket holds the keys
   that begin with its bits; its folder names how many bits and which.
3. A bucket with more entries than the capacity is split: its file is read and
   written again as buckets of more bits, which doubles the directory where the
   bucket was as deep as the directory itself. Buckets that fit aren't touched.
   A bucket of a single key can't be split and stays one chain.
4. Each bucket, a range of keys, goes to one owner task, which chains the entries
   of a key, compares their bytes, and adds up entries of equal bytes.
5. Rows take over the survivor and size of their link by a join on key and SHA-256;
   adaptive execution splits a hot key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, if_small, shared_folder, table, text_of, unused

#: Entries that a hot text may leave.
SALTS = 16
#: Bits that a bucket's number can have.
MAX_DEPTH = 63
ENTRY = "key long, tag string, norm string, n long, keep_id {id}, bucket long"


def bucket_of(depth: int) -> Column:
    """The first `depth` bits of a key."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


@dataclass
class BucketFiles:
    """Buckets as Parquet folders `depth=<bits>/bucket=<number>` in `base`; split ones stay there but are dead."""

    base: str
    schema: str
    capacity: int
    dead: dict[int, list[int]] = field(default_factory=dict)
    depths: set[int] = field(default_factory=set)

    def write(self, entries: DataFrame, depth: int) -> None:
        """One file a bucket."""
        named = entries.withColumn("bucket", bucket_of(depth)).repartition("bucket")
        named.write.mode("append").partitionBy("bucket").parquet(f"{self.base}/depth={depth}")
        self.depths.add(depth)

    def read(self, spark, depth: int) -> DataFrame:
        rows = spark.read.schema(self.schema).parquet(f"{self.base}/depth={depth}")
        return rows.filter(~F.col("bucket").isin(self.dead[depth])) if self.dead.get(depth) else rows

    def split(self, spark) -> None:
        """Splits overfull buckets until none is left that has more than one key; by as many bits as the fill asks for."""
        fresh = set(self.depths)
        while fresh:
            wanted: dict[tuple[int, int], list[int]] = {}
            for depth in sorted(fresh):
                fill = self.read(spark, depth).groupBy("bucket").agg(F.count("*").alias("n"), (F.min("key") < F.max("key")).alias("several"))
                for row in fill.filter((F.col("n") > self.capacity) & F.col("several")).collect() if depth < MAX_DEPTH else ():
                    to = min(MAX_DEPTH, depth + ceil(log2(row["n"] / self.capacity)))
                    wanted.setdefault((depth, to), []).append(row["bucket"])
            fresh = set()
            for (depth, to), buckets in wanted.items():
                self.write(self.read(spark, depth).filter(F.col("bucket").isin(buckets)).drop("bucket"), to)
                fresh.add(to)
            for (depth, _), buckets in wanted.items():
                self.dead.setdefault(depth, []).extend(buckets)

    def live(self, spark) -> DataFrame:
        """All entries with the depth and number of their bucket."""
        parts = [self.read(spark, depth).withColumn("depth", F.lit(depth)) for depth in sorted(self.depths)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def index_entries(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """(doc_id, row, key, sha): an entry for each row, checkpointed. key_bits shortens keys, to force collisions in tests."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), ascii_lower(text_of()).alias("norm"))
    return cut(rows.select("doc_id", "row", _key(key_bits).alias("key"), F.sha2("norm", 256).alias("sha")))


def _key(bits: int) -> Column:
    key = F.xxhash64("norm")
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def build(docs: DataFrame, shared: DataFrame, capacity: int, key_bits: int = 64, tag_chars: int = 64) -> BucketFiles:
    """Bucket files of the texts whose keys are in `shared`, a checkpoint."""
    spark = docs.sparkSession
    texts = (
        docs.select("doc_id", ascii_lower(text_of()).alias("norm"))
        .select("doc_id", "norm", _key(key_bits).alias("key"))
        .join(if_small(shared), "key", "left_semi")
        .withColumn("tag", F.substring(F.sha2("norm", 256), 1, tag_chars))
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    )
    folded = texts.groupBy("key", "tag", "norm", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).drop("salt")
    files = BucketFiles(f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}", ENTRY.format(id=dict(docs.dtypes)["doc_id"]), capacity)
    # the keys are counted, so the index is loaded at the depth where its buckets are half full, and grows from there
    keys = shared.count()
    files.write(folded, max(0, ceil(log2(2 * keys / capacity))) if keys else 0)
    files.split(spark)
    return files


def chains(files: BucketFiles, spark) -> DataFrame:
    """(depth, bucket, key, tag, link, sha, group_size, keep_id): a row for each distinct text, by the owners of the buckets."""
    owned = files.live(spark).repartition("depth", "bucket")
    # the owner has its bucket whole, so neither the comparison of bytes nor the numbering of links moves a row
    links = owned.groupBy("depth", "bucket", "key", "tag", "norm").agg(F.sum("n").alias("group_size"), F.max("keep_id").alias("keep_id"))
    chain = Window.partitionBy("depth", "bucket", "key", "tag").orderBy("norm")
    links = links.withColumn("link", F.row_number().over(chain)).withColumn("sha", F.sha2("norm", 256))
    return cut(links.select("depth", "bucket", "key", "tag", "link", "sha", "group_size", "keep_id"))


def exact_groups(docs: DataFrame, capacity: int = 16_384, key_bits: int = 64, tag_chars: int = 64) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, key.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id of a group stays (a null doc_id is below all
    others). Rows repeated with one doc_id and text are copies of each other:
    just one of them is kept. Other columns of `docs` aren't read. An empty
    table gives an empty result. Rows meet their link by key and SHA-256, so two
    texts with one SHA-256, which owners tell apart, aren't expected to exist.
    """
    index = index_entries(docs, key_bits)
    shared = cut(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    links = chains(build(docs, shared, capacity, key_bits, tag_chars), docs.sparkSession)
    links = links.select(*(F.col(c).alias(f"_{c}") for c in ("key", "sha", "group_size", "keep_id")))
    out = index.join(links, (F.col("key") == F.col("_key")) & (F.col("sha") == F.col("_sha")), "left")
    out = out.select(
        "doc_id",
        "row",
        "key",
        F.when(F.col("_group_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("sha").alias("text_sha256"),
    )
    return _mark(out)


def _mark(out: DataFrame) -> DataFrame:
    """Adds kept: of rows repeated with the survivor's doc_id and text, the last stays."""
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = cut(out)
    again = out.filter(own).groupBy("key", "text_sha256").agg(F.count("*").alias("m"), F.max("row").alias("last")).filter("m > 1")
    if again.isEmpty():
        marked = out.withColumn("kept", own)
    else:
        marked = out.join(again, ["key", "text_sha256"], "left").withColumn(
            "kept", own & (F.col("last").isNull() | (F.col("row") == F.col("last")))
        )
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "key")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose text another row keeps; all columns stay."""
    groups = cut(exact_groups(docs))
    sha = unused(docs, "_sha")
    named = docs.withColumn(sha, F.sha2(ascii_lower(text_of()), 256))
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")
    )
    same = named["doc_id"].eqNullSafe(gone["gone_id"]) & (named[sha] == gone["gone_sha"])
    left = named.join(if_small(gone), same, "left_anti")
    if not groups.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():
        left = left.dropDuplicates(["doc_id", sha])
    return left.drop(sha)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("key")


ORACLE = """
with t as (
  select doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""
