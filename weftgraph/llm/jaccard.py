"""N-gram Jaccard join by prefix filtering.

Words are hashed, and n of them in a row make a shingle, a 64-bit number. A
document's set gets a 128-bit digest, its class: documents of one class are
copies, and only classes are compared.

1. One scan gives each row's class and, per task, counts of shingles in a
   table of fixed size by the low bits of their hash. Summed over all tasks it
   orders shingles, rarest first (a total order with the hash as tie-break;
   any total order gives right results, this one gives short lists).
2. A second scan posts the prefix of each class: n - ceil(t n) + 1 rarest
   shingles of n. Two sets that reach similarity t share one of them. Most of
   these are posted once in the whole corpus: a filter of those that aren't
   keeps them in their task. Postings meet by shingle, and what passed the
   filter though one class alone posts it goes.
3. Star rounds: on each shingle, the classes that stand first in the order
   (fewest rarer shingles before it) lead: one in the first two rounds, then
   eight times as many in each. Every other class on the shingle that passes the filters is
   paired with the leaders; pairs are made distinct and verified once on their
   texts. Links give components, and pairs within one needn't be tried.
4. A leader's posting is settled after its round: what may link to it there has
   been tried. Of the rest, postings go that can't pair with one of another
   component any more, and rounds end when none are left. So a group of k near
   copies costs about k verifications, and no link between components is lost.

Bounds count what two sets may share: before their meeting shingle, what stands
before it in both prefixes and is open (may pair with another component; a
shared one is open for both); after it, what is open in both prefixes, and what
follows the prefix that ends first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, if_small, packed, table, unused
from .components import components
from .twice import twice

#: Entries of the table of counts, and the slices it is summed in.
COUNTS, SLICES = 1 << 20, 64
#: Bits of the filter of prefix shingles, as a power of two: a broadcast of at most 32 MB.
FILTER_BITS = 28
#: Pairs that a task verifies at least, before there are more tasks.
PAIRS = 500
#: Postings of a shingle up to which each is held against the others before pairs are made.
LONG_RUN = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles. bytes.lower and bytes.split treat A-Z and [\\x20\\x09-\\x0D] alone."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : len(words) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def class_of(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, in the global order, that a set must post."""
    n = len(shingles)
    rank = counts[shingles & np.uint64(COUNTS - 1)]
    order = np.lexsort((shingles, rank))
    return shingles[order[: n - -(-percent * n // 100) + 1]]


def suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of the shingles shared: parts of both sets by their top byte share at most the smaller part."""
    parts = [np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256) for x in (a, b)]
    return int(np.minimum(*parts).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    total = len(a) + len(b)
    enough = lambda shared: 100 * shared >= percent * (total - shared)
    if not enough(min(len(a), len(b))) or not enough(suffix_bound(a, b)):
        return False
    return enough(len(np.intersect1d(a, b, assume_unique=True)))


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: sets of hashes are larger than their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _classes(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, class, digest of the text), checkpointed, and the counts of all shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTS, np.int64)
        for batch in _small(batches):
            sets = [shingle_set(text, n) for text in _texts(batch, "text")]
            own += np.bincount(
                (np.concatenate([*sets, np.empty(0, np.uint64)]) & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS
            )
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array(map(len, sets), pa.int64()),
                "class": pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()),
                "digest": batch.column("digest").cast(pa.binary()),
                "slice": pa.nulls(len(sets), pa.int32()),
                "counts": pa.nulls(len(sets), pa.binary()),
            })
        blobs = [zlib.compress(x.tobytes(), 1) for x in own.astype(np.uint32).reshape(SLICES, -1)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(SLICES, pa.int64()),
            "n_shingles": pa.nulls(SLICES, pa.int64()),
            "class": pa.nulls(SLICES, pa.binary()),
            "digest": pa.nulls(SLICES, pa.binary()),
            "slice": pa.array(range(SLICES), pa.int32()),
            "counts": pa.array(blobs, pa.binary()),
        })

    schema = "doc_id long, n_shingles long, class binary, digest binary, slice int, counts binary"
    scanned = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest().alias("digest")).mapInArrow(scan, schema))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
                sums[k] = sums[k] + own if k in sums else own
        blobs = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(sums, pa.int32()), "counts": pa.array(blobs, pa.binary())})

    counts = np.zeros((SLICES, COUNTS // SLICES), np.uint32)
    slices = scanned.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
    for k, blob in slices.mapInArrow(add_up, "slice int, counts binary").collect():  # 4 MB, whatever the input
        counts[k] = np.frombuffer(blob, np.uint32)
    return scanned.filter("slice is null").select("doc_id", "n_shingles", "class", "digest"), counts.reshape(-1)


def _postings(docs: DataFrame, counts: np.ndarray, n: int, percent: int, size: int, bits: int = FILTER_BITS) -> DataFrame:
    """(shingle, class, n, pos, ahead, behind, lead_class, lead_n, lead_pos) of the prefixes; cached for the caller to release.

    Only shingles that two classes or more post are there. ahead, behind: such
    postings of the class before and after this one. lead: the shingle's first
    posting by pos, n, class. size: bytes of text.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, int, np.ndarray]]]:
        """(class, size, prefix) of the sets of some rows."""
        seen: set[bytes] = set()  # copies in one task post once
        for batch in _small(batches):
            out = []
            for text in _texts(batch, "text"):
                own = shingle_set(text, n)
                name = class_of(own)
                if not len(own) or name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                out.append((name, len(own), prefix(own, shared.value, percent)))
            if out:
                yield out

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for some in prefixes(batches):
            yield np.concatenate([first for *_, first in some])

    met = context.broadcast(twice(docs.select("text"), hashes, size, bits))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = met.value.bitmap()
        for some in prefixes(batches):
            shingles, classes, sizes, places = [], [], [], []
            for name, total, first in some:
                place = np.flatnonzero(met.value.passes(bitmap, first) | (first == 0))
                shingles.append(first[place])
                classes += [name] * len(place)
                sizes.append(np.full(len(place), total, np.int32))
                places.append(place.astype(np.int32))
            if classes:
                yield pa.RecordBatch.from_pydict({
                    "shingle": pa.array(np.concatenate(shingles).view(np.int64)),
                    "class": pa.array(classes, pa.binary()),
                    "n": pa.array(np.concatenate(sizes)),
                    "pos": pa.array(np.concatenate(places)),
                })

    def not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops shingles of one class and names the first posting of each run.

        Rows come sorted by shingle, so a row's neighbours tell; the last row
        waits for the next batch, with the first of its run.
        """
        held, lead = None, None  # lead: set if the held row's run began before it

        def named(batch: pa.RecordBatch, leads: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int32(), pa.int32())
            own = [pa.array(c, t) for c, t in zip(zip(*leads, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "lead_class", "lead_n", "lead_pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            shingle, names = both.column(0).to_numpy(), both.column(1).to_pylist()
            fresh = np.ones(len(names), bool)
            fresh[1:] = [x != y for x, y in zip(names[1:], names, strict=False)]
            fresh[1:] |= shingle[1:] != shingle[:-1]
            rows = np.flatnonzero(fresh)
            shingle = shingle[rows]
            same = np.concatenate([[False], shingle[1:] == shingle[:-1]])
            goes = same.copy()
            goes[:-1] |= same[1:]
            goes[0] |= lead is not None
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
            place = lambda k: tuple(both.column(c)[int(rows[k])].as_py() for c in (1, 2, 3))
            of = {int(k): place(k) for k in np.unique(first[goes])}
            if lead is not None:
                of[0] = lead
            out = np.flatnonzero(goes[:-1])
            if len(out):
                yield named(both.take(pa.array(rows[out])), [of[int(k)] for k in first[out]])
            held = pa.Table.from_batches([both.slice(int(rows[-1]), 1)]).combine_chunks().to_batches()[0]
            lead = of[int(first[-1])] if goes[-1] else None
        if held is not None and lead is not None:
            yield named(held, [lead])

    schema = "shingle long, class binary, n int, pos int"
    posted = docs.select("text").mapInArrow(post, schema)
    met = posted.repartition("shingle").sortWithinPartitions("shingle", "pos", "n", "class")
    met = met.mapInArrow(not_alone, f"{schema}, lead_class binary, lead_n int, lead_pos int")
    return _counted(met).persist(StorageLevel.MEMORY_AND_DISK)


def _counted(postings: DataFrame) -> DataFrame:
    """Adds ahead and behind: how many postings of the class stand before and after each."""
    own = Window.partitionBy("class").orderBy("pos")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return postings.withColumn("ahead", F.row_number().over(own) - 1).withColumn(
        "behind", (F.count("*").over(whole) - F.col("ahead") - 1).cast("int")
    )


def _may_link(x: str, y: str, percent: int, lead: bool = False) -> Column:
    """Length, positional and suffix filters of two postings of one shingle.

    What two sets share before it stands in both prefixes, so is among the
    `ahead` open postings of both. What they share after it is among those
    `behind` in both, up to where one prefix ends, or follows that; and in the
    shorter rest. lead: of y only place and size are known, which bound its counts.
    """
    n, n2, pos, pos2, ahead, behind = *(F.col(f"{side}{c}") for c in ("n", "pos") for side in (x, y)), F.col(f"{x}ahead"), F.col(f"{x}behind")
    beyond = lambda size: F.floor((size * percent + 99) / 100) - 1
    ahead2, behind2 = (pos2, n2 - beyond(n2) - pos2 - 1) if lead else (F.col(f"{y}ahead"), F.col(f"{y}behind"))
    length = F.least(n, n2) * 100 >= F.greatest(n, n2) * percent
    after = F.least(F.least(behind, behind2) + F.greatest(beyond(n), beyond(n2)), n - pos - 1, n2 - pos2 - 1)
    most = F.least(ahead, ahead2) + 1 + after
    return length & (most * 100 >= (n + n2 - most) * percent)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, link) of each pair; checkpointed. Only texts of classes that stand in pairs are moved."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # a leader's pairs come one after another
        for batch in batches:
            out = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for name, x, y in zip(b, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if name != last:
                    last, kept = name, shingle_set(zlib.decompress(y), n)
                out.append(linked(shingle_set(zlib.decompress(x), n), kept, percent))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "link": pa.array(out)})

    pairs = packed(cut(pairs.select("a", "b")), PAIRS)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    texts = _class_texts(docs, classes, cut(wanted), n)

    def side(name: str) -> DataFrame:
        """Texts of the classes that stand on this side; a round has few leaders."""
        own = texts.join(if_small(cut(pairs.select(F.col(name).alias("class")).distinct())), "class", "left_semi")
        return own.select(F.col("class").alias(name), F.col("text").alias(f"text_{name}"))

    joined = side("a").join(if_small(pairs), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return packed(cut(joined.mapInArrow(verify, "a binary, b binary, link boolean")))


def _class_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, text) for the classes in `wanted`, of one row each; checkpointed. Texts are compressed: pairs move them."""
    reps = classes.join(if_small(wanted), "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("rep"))
    reps = packed(cut(reps.withColumnRenamed("class", "expected")))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows may share a doc_id and not the text
            got = [class_of(shingle_set(x, n)) for x in _texts(batch, "text")]
            fit = [i for i, (x, y) in enumerate(zip(got, batch.column("expected").to_pylist(), strict=True)) if x == y]
            if fit:
                texts = _texts(batch, "text")
                yield pa.RecordBatch.from_pydict({
                    "class": pa.array([got[i] for i in fit], pa.binary()),
                    "text": pa.array([zlib.compress(texts[i], 1) for i in fit], pa.binary()),
                })

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = own.join(if_small(reps), F.col("doc_id").eqNullSafe(F.col("rep"))).select("expected", "text")
    return packed(cut(found.mapInArrow(right, "class binary, text binary")), PAIRS)


def class_links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class, digest) of all rows, and (node, component) of the classes that have links."""
    classes, counts = _classes(docs, n)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    postings = _postings(docs, counts, n, percent, size)
    fit = (F.col("class") != F.col("lead_class")) & _may_link("", "lead_", percent, lead=True)
    tried = _verified(_once(postings.filter(fit), "class", "lead_class"), docs, classes, n, percent)
    labels = components(tried.filter("link"))
    # whatever may link to a leader on its shingle has been tried, so the leader's own posting is settled
    left = postings.filter("class <> lead_class").select(*OPEN[:-1])
    open_ = _open(_labelled(left, labels), percent, times=2)
    postings.unpersist()
    leaders = 1
    while not open_.isEmpty():
        order = Window.partitionBy("shingle").orderBy("pos", "n", "class")
        ranked = open_.withColumn("turn", F.row_number().over(order))
        x, y = ranked.alias("x"), ranked.filter(F.col("turn") <= leaders).alias("y")
        fit = (F.col("x.turn") > F.col("y.turn")) & (F.col("x.component") != F.col("y.component")) & _may_link("x.", "y.", percent)
        pairs = _once(x.join(y, F.col("x.shingle") == F.col("y.shingle")).filter(fit), "x.class", "y.class")
        known = tried.select("a", "b").unionAll(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        done = _verified(pairs.join(known, ["a", "b"], "left_anti"), docs, classes, n, percent)
        tried = tried.unionAll(done)
        if not done.filter("link").isEmpty():
            labels = components(tried.filter("link"))
        left = ranked.filter(F.col("turn") > leaders).drop("turn", "component", "ahead", "behind")
        open_ = _open(_labelled(left, labels), percent)
        leaders *= 8
    return classes, labels


def _once(met: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): each pair of classes in one direction, whichever it met in."""
    pair = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = met.select(pair.alias("pair")).groupBy(F.least("pair.a", "pair.b").alias("u"), F.greatest("pair.a", "pair.b").alias("v"))
    return both.agg(F.max("pair").alias("pair")).select("pair.a", "pair.b")


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with the component of their class, which is the class itself where nothing links to it."""
    own = labels.select(F.col("node").alias("class"), F.col("component").alias("of"))
    return postings.join(if_small(own), "class", "left").withColumn("component", F.coalesce("of", "class")).drop("of")


OPEN = ("shingle", "class", "n", "pos", "ahead", "behind", "component")


def _open(named: DataFrame, percent: int, longest: int = LONG_RUN, times: int = 2) -> DataFrame:
    """Postings that may pair with one of another component on the same shingle; checkpointed.

    Those that go make the bounds of the rest tighter, so they are held against each other `times` times.

    Rows come sorted by shingle; each is held against the others of its shingle
    by the filters. Shingles of more than `longest` postings stay whole, so no
    group is held in memory beyond that.
    """

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whole = None, None  # held: the last shingle's rows so far; whole: a long shingle that goes on
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            yield from sifted(rows.slice(0, _last_run(rows)), whole)
            held = rows.slice(_last_run(rows)).combine_chunks()
            if held.num_rows > longest:
                whole = held.column(0)[0].as_py()
                yield from held.to_batches()
                held = held.slice(0, 0)
            held = held.to_batches()[0] if held.num_rows else None
        if held is not None:
            yield from sifted(pa.Table.from_batches([held]), whole)

    def sifted(rows: pa.Table, whole: int | None) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        rows = rows.combine_chunks()
        shingle, n, pos, ahead, behind = (rows.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n", "pos", "ahead", "behind"))
        beyond = (n * percent + 99) // 100 - 1
        part = np.array(rows.column("component").to_pylist(), "S16")
        keep = shingle == whole if whole is not None else np.zeros(len(shingle), bool)
        for k in range(1, len(shingle)):
            same = shingle[k:] == shingle[:-k]
            if not same.any():
                break
            a, b = np.flatnonzero(same), np.flatnonzero(same) + k
            after = np.minimum(behind[a], behind[b]) + np.maximum(beyond[a], beyond[b])
            most = np.minimum(ahead[a], ahead[b]) + 1 + np.minimum(after, np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1)
            fit = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (100 * most >= percent * (n[a] + n[b] - most))
            fit &= part[a] != part[b]
            keep[a[fit]] = keep[b[fit]] = True
        if keep.any():
            yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    schema = "shingle long, class binary, n int, pos int, ahead int, behind int, component binary"
    for _ in range(times):
        own = _counted(named.drop("ahead", "behind")).select(*OPEN)
        named = packed(cut(own.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(partners, schema)))
    return named


def _last_run(rows: pa.Table) -> int:
    """Where the rows of the last shingle begin."""
    shingle = rows.column(0).to_numpy()
    return int(np.searchsorted(shingle, shingle[-1])) if len(shingle) else 0


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`.

    Words are what stands between [\\x20\\x09-\\x0D]; A-Z count as a-z. A set holds
    the distinct runs of `n` words, of a text with fewer words the whole
    sequence. Two rows link when 100 * shared >= percent * union of their sets;
    component_id is the least doc_id that links lead to. A null or wordless text
    has n_shingles 0, links with nothing and keeps its own doc_id. Rows repeated
    with one doc_id each get a row. Only doc_id and text are read; an empty
    table gives an empty result. Shingles are told apart by 64-bit hashes.
    """
    classes, labels = class_links(docs, n, percent)
    own = _groups(classes, labels, F.min("doc_id"))
    return classes.join(own, "class", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _groups(classes: DataFrame, labels: DataFrame, least: Column) -> DataFrame:
    """(class, least): the least value over the rows of its group, for classes of two rows or more or with links."""
    reps = classes.filter("class is not null").groupBy("class").agg(least.alias("rep"), F.count("*").alias("rows"))
    own = reps.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").filter(
        "rows > 1 or component is not null"
    )
    own = cut(own.withColumn("component", F.coalesce("component", "class")))
    first = own.groupBy("component").agg(F.min("rep").alias("least"))
    return own.select("class", "component").join(first, "component").select("class", "least")


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs`, all columns, with one row of each group: of least doc_id, null ids last, and then of least SHA-256.

    A row is told by its doc_id and its text, so others of the same id, or of
    none, stay if they aren't near copies. Of rows equal in both, one stays.
    """
    classes, labels = class_links(docs, n, percent)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    joined = classes.join(_groups(classes, labels, F.min(key)), "class")
    groups = cut(joined.select("doc_id", "digest", key.eqNullSafe(F.col("least")).alias("stays")))
    text, number = unused(docs, "_digest"), F.col("doc_id").cast("long")
    rows = docs.withColumn(text, _digest())

    def met(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("key_id"), F.col("digest").alias("key_digest"))
        return rows.join(if_small(keys), number.eqNullSafe(F.col("key_id")) & (F.col(text) == F.col("key_digest")), how)

    left = met(groups.filter("not stays").distinct(), "left_anti", rows)
    again = cut(groups.filter("stays").groupBy("doc_id", "digest").count().filter("count > 1"))
    if not again.isEmpty():
        left = met(again, "left_semi", left).dropDuplicates(["doc_id", text]).unionByName(met(again, "left_anti", left))
    return left.drop(text)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, md5(array_to_string(w[i : i + least(4, len(w)) - 1], ' ')) as sh
  from (select doc_id, w, unnest(range(1, cast(len(w) - least(4, len(w)) + 2 as bigint))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r(node, root) as (select distinct a, a from e union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as root from r group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.root, d.doc_id) as component_id
from d left join n using (doc_id) left join c on c.node = d.doc_id
"""
