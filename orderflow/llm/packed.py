"""Hashes of a whole corpus, counted in packed rows.

A task sends its hashes in few rows: one for each bucket (the upper bits of a
hash) and slice of text, with the values of the bucket packed into binary
columns. Every slice sends a hash once, however often it has it, so a hot hash
has at most as many entries as there are slices. Buckets are sized by the
input, so the task that merges one holds a bounded part of all hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderflow.llm.common import text_bytes
from orderflow.llm.jaccard_join import _SPACE, _power_tables, mix
from orderflow.session import input_bytes

#: Bytes of input for which there is a bucket, and the least and largest number of bits of one.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 8 << 20, 8, 24
#: Bits of a bitmap over hashes: 16 MB, whatever the input. When it fills up, more is looked at, nothing is lost.
MAP_BITS = 27


def map_bits_of(bits: np.ndarray) -> int:
    return len(bits).bit_length() + 2  # a power of two of bytes


def bucket_bits(docs: DataFrame) -> int:
    size = input_bytes(docs) or 0
    size = size if size < 1 << 60 else 0  # Spark gives tables of unknown size a huge one
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values[cuts[i]:cuts[i + 1]] as one binary value each."""
    values = np.ascontiguousarray(values)
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The values of all rows, one row after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def bucket_cuts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted hashes, and where each begins, with the end."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    first = runs(bucket)
    return bucket[first], np.r_[first, len(bucket)]


def words_of(texts: pa.Array, lower: np.ndarray | None = None, space: np.ndarray = _SPACE, breaks: np.ndarray | None = None):
    """(data, start, stop, hash of each word, first word of each text, its end) of words between white space.

    ``lower`` maps bytes before they are hashed; ``breaks`` marks bytes that end
    words as white space does. The data are the mapped bytes.
    """
    data, at = text_bytes(texts)
    if lower is not None:
        data = lower[data]
    inside = ~space[data] if breaks is None else ~(space[data] | breaks[data])
    edges = at[1:-1][(at[1:-1] < len(data)) & (at[1:-1] > 0)]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return data, start, stop, span_hashes(data, start, stop), np.searchsorted(start, at)


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop]; equal bytes have equal hashes wherever they are."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def is_marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - map_bits_of(bits))).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def marks(hashes: np.ndarray, bits: int, map_bits: int = MAP_BITS) -> bytes:
    """The part of the bitmap that belongs to the one bucket of these hashes."""
    size = max(0, map_bits - bits)
    inner = ((hashes << np.uint64(bits)) >> np.uint64(64 - size)).astype(np.int64) if size else np.zeros(len(hashes), np.int64)
    out = np.zeros(max(1 << size, 8), np.uint8)
    out[inner] = 1
    return np.packbits(out, bitorder="little").tobytes()


def gathered(parts: DataFrame, bits: int, map_bits: int = MAP_BITS) -> np.ndarray:
    """The whole bitmap from (bucket, marks) rows: fixed in size, whatever the input."""
    out = np.zeros(1 << (map_bits - 3), np.uint8)
    size = max(0, map_bits - bits - 3)
    for row in parts.toLocalIterator():
        at = row["bucket"] << size
        part = np.frombuffer(bytes(row["marks"]), np.uint8)
        out[at : at + len(part)] |= part
    return out
