"""A filter of the hashes that occur twice in a table, built without moving rows.

Each task sends its hashes, distinct, sorted, as differences and packed, to the
owners of slices of their range; an owner adds them up and sets the bits of
those that occur twice or more. The filter has a fixed number of bits, so that
it can be broadcast at any size of the input; when it fills, more hashes pass
and what is built on it stays the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits set for a value; the least number of slices, bits of a value with those, and bytes of input for each slice beyond.
PROBES, SLICES, VALUE_BITS, SLICE_BYTES = 3, 64, 40, 1 << 24
#: Hashes that a task holds before it packs them.
HELD = 3_000_000
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _value_bits(slices: int) -> int:
    """Bits of a value: a slice holds as many bytes of input at every size, so each doubling of slices adds a bit."""
    return min(64, VALUE_BITS + (slices // SLICES).bit_length() - 1)


def _positions(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of values in a slice of the filter with so many bits."""
    for k in range(PROBES):
        yield ((values * _P[k]) >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)


class Twice:
    """The filter as the driver gets it: compressed slices, and the values that occur more than `hot` times."""

    def __init__(self, blobs: list[bytes], hot: np.ndarray):
        self.blobs, self.hot, self.slices = blobs, hot, len(blobs)

    def bitmap(self) -> np.ndarray:
        size = len(zlib.decompress(self.blobs[0]))
        out = np.empty(size * self.slices, np.uint8)
        for k, blob in enumerate(self.blobs):
            out[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(blob), np.uint8)
        return out

    def values(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - _value_bits(self.slices))

    def passes(self, bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which hashes occur twice, and a few more; 0 stands for none."""
        values = self.values(hashes)
        own_bits = len(bitmap) * 8 // self.slices
        start = (values // np.uint64((1 << _value_bits(self.slices)) // self.slices)).astype(np.int64) * own_bits
        out = hashes > 0
        for at in _positions(values, own_bits):
            at += start
            out &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def twice(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int, bits: int, hot: int = 2**62) -> Twice:
    """The filter of the 64-bit `hashes` of all `rows`, of 2^bits bits. size: bytes of input, for the number of slices.

    The driver gets at most 2^bits / 8 bytes, and a value for each that occurs more than `hot` times.
    """
    slices = SLICES
    while slices < size / SLICE_BYTES:
        slices *= 2
    value_bits = _value_bits(slices)
    per_slice, own_bits = (1 << value_bits) // slices, max(8, (1 << bits) // slices)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def packed() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values >>= np.uint64(64 - value_bits)
            values.sort()
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
            times = np.diff(first, append=len(values))
            values = values[first]
            del first
            cuts = np.searchsorted(values, np.arange(1, slices, dtype=np.uint64) * np.uint64(per_slice))
            times = np.minimum(times, 65535).astype(np.uint16)
            seen, often = [], []
            for v, t in zip(np.split(values, cuts), np.split(times, cuts), strict=True):
                # bytes stand by their place in the value, which packs better
                steps = np.diff(v, prepend=np.uint64(0)).astype(np.uint64).view(np.uint8).reshape(-1, 8).T
                seen.append(zlib.compress(steps.tobytes(), 1))
                often.append(zlib.compress(t.tobytes(), 1))
            return pa.RecordBatch.from_pydict({
                "slice": pa.array(range(slices), pa.int32()), "seen": pa.array(seen, pa.binary()), "times": pa.array(often, pa.binary()),
            })

        for own in hashes(batches):
            held.append(own)
            count += len(own)
            if count > HELD:
                yield packed()
                held, count = [], 0
        if held:
            yield packed()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in batches:
            for k, seen, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                steps = np.frombuffer(zlib.decompress(seen), np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1)
                own.setdefault(k, []).append((np.cumsum(steps, dtype=np.uint64), np.frombuffer(zlib.decompress(often), np.uint16)))
        for k, parts in own.items():
            values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            times = np.bincount(place, np.concatenate([t for _, t in parts]), len(values))
            filled = np.zeros(own_bits, bool)
            for at in _positions(values[times > 1], own_bits):
                filled[at] = True
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([k], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(filled).tobytes(), 1)], pa.binary()),
                "hot": pa.array([values[times > hot].tobytes()], pa.binary()),
            })

    scanned = rows.mapInArrow(scan, "slice int, seen binary, times binary")
    out = [zlib.compress(bytes(own_bits // 8), 1)] * slices
    often = []
    for k, blob, values in scanned.repartition(slices, "slice").mapInArrow(add_up, "slice int, bits binary, hot binary").collect():
        out[k] = blob
        often.append(bytes(values))
    return Twice(out, np.sort(np.frombuffer(b"".join(often), np.uint64)))
