"""Removal of repeated byte strings with a run-length index of the repetitive part of the corpus.

A string of `length` bytes that occurs twice has the same least GRAM-byte gram,
its anchor, at both places. Starts of strings that follow each other and share
an anchor form a segment; equal strings are always in segments of one anchor.

1. One scan sends hashes of every anchor, and of the anchor with the bytes on
   its left or right (each string holds one of the two), packed, to slices that
   count them. Those that occur twice make a Bloom filter of a fixed size; when
   a corpus outgrows it more segments pass, and results stay the same.
2. A second scan cuts out segments that pass. Equal segments of a task are
   folded at once: all but the first place are repeats as a whole. The strings
   of anchors that occur more than HOT times go one by one, each its own group.
3. Segments meet by anchor, first places first. Equal ones are one phrase of a
   dictionary, as in prefix-free parsing. Where an anchor has several phrases,
   they are indexed: the Burrows-Wheeler transform of their text, in the order
   of contexts of `length` bytes and places, is kept as runs with a sampled
   place for each, and the phrases are streamed past it, byte by byte from
   their ends. A start whose match reaches `length` bytes, and whose sampled
   place is an earlier one, is a repeat.
4. Spans of repeats are joined to the rows, and the bytes left are hashed.

Places are ordered by doc_id, then for rows that share one by a hash of the
text, then by start.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import table
from .twice import twice

LENGTH = 100
GRAM = 32
#: Bits of the filter, as a power of two: a broadcast of at most 64 MB.
FILTER_BITS = 29
#: Bytes of text hashed at once; a longer text is taken in pieces.
PIECE = 1 << 19
#: Rows of a batch that are turned into Python's values at once, and rows of a batch that is handed back.
TAKEN, HANDED = 1_000, 8_192
#: Bytes of segments indexed at once, and occurrences of an anchor from which its strings go one by one.
INDEX_BYTES, HOT = 1 << 21, 20_000
_PLACE = np.uint64((1 << 20) - 1)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each place."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    n = len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        out += words[8 * k : 8 * k + n]
        out *= _P[k]
        out ^= out >> np.uint64(29)
    out *= _P[0]
    out ^= out >> np.uint64(32)
    return out


def segments(data: np.ndarray, ends: list[tuple[int, int]], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of texts at (begin, end) in `data`: first start, last start, anchor's place, and three hashes:
    of the anchor, of it with the bytes on its left, and with those on its right.

    A string whose anchor stands at its middle or beyond holds the bytes on the
    left, any other those on the right; a hash is 0 where no start needs it.
    """
    none = *(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(3))
    if len(data) < length:
        return none
    grams = _grams(data)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, length - GRAM + 1
    while 2 * width <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < span:
        keys = np.minimum(keys[: len(keys) - (span - width)], keys[span - width :])
    valid = np.zeros(len(keys) + 1, bool)
    for begin, end in ends:
        if end - begin >= length:
            valid[begin : end - length + 1] = True
    anchor = (keys & _PLACE).astype(np.int64)
    same = np.zeros(len(keys), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & valid[:-2]
    first = np.flatnonzero(valid[:-1] & ~same)
    if not len(first):
        return none
    stays = np.zeros(len(keys), bool)
    stays[:-1] = same[1:] & valid[1:-1]
    last = np.flatnonzero(valid[:-1] & ~stays)
    at = anchor[first]
    half = (length - GRAM) // 2
    base, top = grams[at], len(grams) - 1

    def beside(*shifts: int) -> np.ndarray:
        out = base * _P[1]
        for k, shift in enumerate(shifts):
            out = (out ^ grams[np.clip(at + shift, 0, top)]) * _P[k % 2 + 2]
            out ^= out >> np.uint64(31)
        return out | np.uint64(1)

    left = np.where(first <= at - half, beside(-half, -GRAM), np.uint64(0))
    # starts past the middle have length - GRAM - half + 1 bytes or more on the right
    more = length - GRAM - half + 1
    right = np.where(last > at - half, beside(GRAM, more), np.uint64(0))
    return first, last, at, base, left, right


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]]:
    """(data, (begin, end) of each part, (text number, place of the part in its text)).

    A text longer than PIECE goes in parts that overlap so that each start is in one.
    """
    data, ends, owners, size = [], [], [], 0
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, PIECE):
            part = text[at : at + PIECE + length - 1]
            if size and size + len(part) > PIECE + length:
                yield b"".join(data), ends, owners
                data, ends, owners, size = [], [], [], 0
            data.append(part)
            ends.append((size, size + len(part)))
            owners.append((k, at))
            size += len(part)
    if size:
        yield b"".join(data), ends, owners


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TAKEN):
            yield batch.slice(at, TAKEN)


def _hashes(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in _taken(batches):
            for data, ends, _ in pieces(_bytes(batch.column(0)), length):
                *_, base, left, right = segments(np.frombuffer(data, np.uint8), ends, length)
                yield np.concatenate([base, left[left > 0], right[right > 0]])

    return of


class RunIndex:
    """Run-length index of a dictionary of phrases: the runs of its Burrows-Wheeler transform, a place sampled for each.

    Rows stand in the order of their contexts, the next `length` bytes as far as
    the phrase goes, and then of their places. A run is a stretch of rows of one
    context and one byte before it. What stays in memory grows with the runs: for
    each its first row, its byte, its sampled place and the rows before it.
    """

    def __init__(self, phrases: list[bytes], length: int):
        """phrases: in the order of their places, so that a place earlier in the text is earlier in the corpus."""
        self.length = length
        sizes = np.array([len(x) for x in phrases])
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b"\0".join(phrases) + b"\0" * 9, np.uint8)
        self.rows = int(sizes.sum()) + len(sizes)
        # rows are few enough for the narrowest types, as several columns of them stand in memory together
        self.kind = np.int32 if self.rows < 1 << 31 else np.int64
        left = np.repeat((self.starts + sizes).astype(self.kind), sizes + 1)
        left -= np.arange(self.rows, dtype=self.kind)
        near, far = self._ranks(raw, left, length)
        order = np.argsort(far, kind="stable").astype(self.kind)
        text = raw[: self.rows].astype(np.int16) + np.int16(1)
        text[left == 0] = 0  # 0 ends a phrase
        before = text[order - 1]
        before[order == 0] = 0
        del text, left
        ranked = far[order]
        fresh = np.ones(self.rows, bool)  # a context's first row begins a run, so its least place is sampled
        fresh[1:] = ranked[1:] != ranked[:-1]
        breaks = fresh.copy()
        breaks[1:] |= before[1:] != before[:-1]
        ranked = near[order]
        wide = np.ones(self.rows, bool)
        wide[1:] = ranked[1:] != ranked[:-1]
        del near, far, ranked
        run_starts = np.flatnonzero(breaks)
        self.heads = before[run_starts].astype(np.int64)
        self.samples = order[run_starts]
        # contexts: their first runs, and the first row of all contexts that share length - 1 bytes with them
        firsts = np.flatnonzero(fresh)
        self.context_run = np.searchsorted(run_starts, firsts)
        self.shared_from = np.maximum.accumulate(np.where(wide, np.arange(self.rows, dtype=self.kind), self.kind(0)))[firsts]
        # runs by byte, then row: those before one, in all, are where its byte and context begin
        by_byte = np.lexsort((run_starts, self.heads))
        self.keys = self.heads[by_byte] * (self.rows + 1) + run_starts[by_byte]
        counts = np.diff(run_starts, append=self.rows)[by_byte]
        self.steps = np.concatenate([[0], np.cumsum(counts)])
        self.step_context = np.searchsorted(firsts, self.steps, "right") - 1

    @staticmethod
    def _ranks(raw: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the next length - 1 and `length` bytes at each place, cut where the phrase ends; by doubling."""
        size, n, kind = 8, len(left), left.dtype
        short = np.minimum(left, 8).astype(np.int8)
        word = np.ndarray((n,), ">u8", raw, 0, (1,)).astype(np.uint64)
        word &= np.array([0, *(2**64 - 2 ** (64 - 8 * k) for k in range(1, 9))], np.uint64)[short]

        def ranks(keys: np.ndarray) -> np.ndarray:
            """Ranks of `keys`, which is sorted in place."""
            order = np.argsort(keys, kind="stable").astype(kind)
            keys.sort(kind="stable")
            steps = np.zeros(n, kind)
            np.cumsum(keys[1:] != keys[:-1], out=steps[1:])
            out = np.empty(n, kind)
            out[order] = steps
            return out

        rank = ranks(word).astype(np.int64)
        del word
        rank *= 9
        rank += short
        rank = ranks(rank)

        def joined(step: int) -> np.ndarray:
            keys = rank.astype(np.int64)
            keys *= n + 1
            after = rank[step:] + kind.type(1)
            after[left[: max(0, n - step)] <= step] = 0
            keys[: n - step] += after
            return ranks(keys)

        while 2 * size < length:
            rank = joined(size)
            size *= 2
        return joined(length - 1 - size), joined(length - size)

    def stream(self, phrases: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of the indexed phrases, all streamed past the runs together, from their last bytes on.

        A step takes each phrase's byte before the match and leads to the rows
        where the match with that byte begins. The match grows to `length` bytes;
        then its last byte goes at each step. Yields, once it is that long, the
        numbers of the phrases, the starts in them, and the earliest places.
        """
        sizes = np.array([len(x) for x in phrases])
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)[order]
        text, sizes = np.frombuffer(b"".join(phrases), np.uint8), sizes[order]
        row = np.zeros(len(order), np.int64)
        context = np.zeros(len(order), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t))  # phrases of more than t bytes
            byte = text[ends[:live] - 1 - t].astype(np.int64) + 1
            row = self.shared_from[context[:live]] if t >= self.length else row[:live]
            at = np.searchsorted(self.keys, byte * (self.rows + 1) + row)
            row, context = self.steps[at], self.step_context[at]
            if t + 1 >= self.length:
                yield order[:live], sizes[:live] - 1 - t, self.samples[self.context_run[context]]


def indexed_repeats(group: list[list[tuple]], length: int) -> Iterator[tuple]:
    """(doc_id, part, begin, end) of strings in (doc_id, part, start, segment) rows that an earlier row holds, or the same one before."""
    rows = [r for g in group for r in g]
    phrases = [r[3] for r in rows]
    index = RunIndex(phrases, length)
    found = []
    for who, at, first in index.stream(phrases):
        places = index.starts[who] + at
        found.append(places[first < places])
    again = np.sort(np.concatenate(found))
    if not len(again):
        return
    owner = np.searchsorted(index.starts, again, "right") - 1
    offset = again - index.starts[owner]
    cuts = np.flatnonzero((np.diff(offset) != 1) | (np.diff(owner) != 0)) + 1
    firsts, lasts = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(again)]]) - 1
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        doc, part, start, _ = rows[owner[a]]
        yield doc, part, start + int(offset[a]), start + int(offset[b]) + length


_SEGMENTS = "anchor long, doc_id long, part long, begin int, end int, segment binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ("anchor", "doc_id", "part", "begin", "end", "segment")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


class Best:
    """The first place of each segment, as four numbers of one array."""

    def __init__(self):
        self.rows, self.places = {}, array("q")

    def __len__(self) -> int:
        return len(self.rows)

    def place(self, row: int) -> tuple:
        return tuple(self.places[4 * row : 4 * row + 4])

    def take(self, own: bytes, now: tuple) -> tuple | None:
        """Keeps the earlier of the place known and (doc_id, part, begin, anchor) `now`; gives the other, None if there is none."""
        row = self.rows.setdefault(own, len(self.rows))
        if 4 * row == len(self.places):
            self.places.extend(now)
            return None
        old = self.place(row)
        if now == old:  # the row is there twice
            return None
        if now < old:
            self.places[4 * row : 4 * row + 4] = array("q", now)
            return old
        return now

    def flushed(self) -> Iterator[pa.RecordBatch]:
        """All segments, in batches, and then none are left."""
        rows, places = self.rows, self.places
        self.rows, self.places = {}, array("q")
        segments, at = iter(rows), 0
        while own := list(islice(segments, HANDED)):
            yield _batch([(places[k + 3], places[k], places[k + 1], places[k + 2], places[k + 2] + len(x), x) for k, x in zip(range(at, at + 4 * len(own), 4), own, strict=True)])
            at += 4 * len(own)


def _cut_out(docs: DataFrame, length: int, bits: int, hot: int) -> DataFrame:
    """Segments that pass the filter, a task's first places only; rows without a segment are repeats."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(twice(docs.select("text"), _hashes(length), size, bits, hot))
    half = (length - GRAM) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = shared.value
        bitmap, hot_ones = met.bitmap(), set(met.hot.tolist())
        best = Best()
        out: list[tuple] = []

        def repeat(anchor: int, doc: int, part: int, begin: int, end: int) -> None:
            if out and out[-1][1:3] == (doc, part) and out[-1][3] <= begin <= out[-1][4]:
                out[-1] = (*out[-1][:4], max(end, out[-1][4]), None)
            else:
                out.append((anchor, doc, part, begin, end, None))

        def take(own: bytes, now: tuple) -> None:
            if (now := best.take(own, now)) is not None:
                repeat(now[3], now[0], now[1], now[2], now[2] + len(own))

        for batch in _taken(batches):
            doc_ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for data, ends, owners in pieces(_bytes(batch.column(2)), length):
                first, last, at, base, left, right = segments(np.frombuffer(data, np.uint8), ends, length)
                on_left, on_right = met.passes(bitmap, left), met.passes(bitmap, right)
                # only the half that may repeat is cut out
                first = np.where(on_left, first, np.maximum(first, at - half + 1))
                last = np.where(on_right, last, np.minimum(last, at - half))
                hit = np.flatnonzero(on_left | on_right)
                owner = np.searchsorted([e for _, e in ends], first[hit], "right")
                named = base[hit].view(np.int64).tolist()
                top = met.values(base[hit]).tolist()
                for s, e, k, anchor, value in zip(first[hit].tolist(), last[hit].tolist(), owner.tolist(), named, top, strict=True):
                    text, place = owners[k]
                    begin = s - ends[k][0] + place
                    if value in hot_ones:
                        for i in range(e - s + 1):
                            own = data[s + i : s + i + length]
                            take(own, (doc_ids[text], parts[text], begin + i, xxh3_64_intdigest(own) - (1 << 63)))
                    else:
                        take(data[s : e + length], (doc_ids[text], parts[text], begin, anchor))
                if len(best) > 300_000:
                    yield from best.flushed()
                for at in range(0, len(out) - HANDED + 1, HANDED):
                    yield _batch(out[at : at + HANDED])
                del out[: len(out) // HANDED * HANDED]
        if out:
            yield _batch(out)
        yield from best.flushed()

    return docs.select("doc_id", "part", "text").mapInArrow(scan, _SEGMENTS)


def _resolve(cut_out: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(doc_id, part, begin, end) of repeats, from segments that come sorted by anchor and place."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting: list[list[tuple]] = []
        size, firsts, anchor = 0, {}, None

        def close() -> int:
            """Ends a group; gives the bytes that now wait for an index."""
            if len(firsts) < 2:
                return 0
            waiting.append([(*place, segment) for segment, place in firsts.items()])
            return sum(map(len, firsts))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "part", "begin", "end"]
            )

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for a, doc, part, begin, end, segment in zip(*columns, strict=True):
                if segment is None:
                    out.append((doc, part, begin, end))
                    continue
                if a != anchor:
                    size += close()
                    firsts, anchor = {}, a
                    if size > index_bytes:
                        # the group that is too much beside the others gets an index of its own
                        for groups in (waiting[:-1], waiting[-1:]):
                            if groups:
                                out += indexed_repeats(groups, length)
                        waiting, size = [], 0
                place = firsts.setdefault(segment, (doc, part, begin))
                if place != (doc, part, begin):
                    out.append((doc, part, begin, end))
            if out:
                yield batch_of(out)
                out = []
        close()
        if waiting:
            out += indexed_repeats(waiting, length)
        if out:
            yield batch_of(out)

    return cut_out.mapInArrow(resolve, "doc_id long, part long, begin int, end int")


def repeat_spans(docs: DataFrame, length: int = LENGTH, bits: int = FILTER_BITS, index_bytes: int = INDEX_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, part, begin, end): spans of `docs` (doc_id, part, text) that occur earlier; they may overlap."""
    met = _cut_out(docs, length, bits, hot).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "part", "begin")
    return _resolve(met, length, index_bytes)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text_left for each row of `docs`.

    Texts are UTF-8 bytes, null is empty. Each byte is removed that a string of
    `length` (100) bytes covers which also starts earlier: in a smaller doc_id,
    or before in the same text. Rows with one doc_id and different texts come in
    the order of a hash of the text; rows repeated whole are one document, given
    twice. A null doc_id comes first. Texts under `length` bytes stay whole.
    text_left is the rest, decoded with replacement where a cut splits a sign.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(
        F.col("doc_id"), order.alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    spans = repeat_spans(keyed.select(F.col("key").alias("doc_id"), "part", "text"), **more)
    # spans of a row: as many as its text has place for
    listed = spans.groupBy("doc_id", "part").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    listed = listed.select(F.col("doc_id").alias("of"), F.col("part").alias("of_part"), "spans")
    joined = keyed.join(listed, (F.col("key") == F.col("of")) & (F.col("part") == F.col("of_part")), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _taken(batches):
            rows = []
            for text, found in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = merged([(s["begin"], s["end"]) for s in found or ()])
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(gone), sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_left"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_left string"
    return joined.select("doc_id", "text", "spans").mapInArrow(finish, schema)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text_left")


ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as k from (select doc_id, h, unnest(range(0, cast(length(h) // 2 - 99 as bigint))) as p from d)),
g as (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as i from w) where i > 1),
m as (select *, case when p <= coalesce(max(p) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), -1000) + 100 then 0 else 1 end as opens from g),
q as (select *, sum(opens) over (partition by doc_id order by p) as span from m),
s as (select doc_id, min(p) as b, max(p) + 100 as e from q group by doc_id, span),
x as (select doc_id, b, e, coalesce(lag(e) over (partition by doc_id order by b), 0) as last_e, row_number() over (partition by doc_id order by b desc) as from_end from s),
k as (
  select d.doc_id, string_agg(substr(h, cast(2 * last_e + 1 as bigint), cast(2 * (b - last_e) as bigint)) || case when from_end = 1 then substr(h, cast(2 * e + 1 as bigint)) else '' end, '' order by b) as kept,
         sum(e - b) as removed, count(*) as n
  from d join x using (doc_id) group by d.doc_id)
select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join k using (doc_id)
"""
