"""Vectorised text kernels: Arrow string columns as byte arrays, word splitting, 64-bit rolling hashes.

Everything works on the UTF-8 bytes that Arrow already holds, so no Python string is made for a word.  Texts are
processed in runs of documents of about ``RUN_BYTES``; a longer single text is one run of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: ``[^\x20\x09-\x0D]`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` on lower-cased UTF-8 bytes.
NON_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    size = max(RUN_BYTES, n) + 1
    if size > RUN_BYTES + 1 or size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > RUN_BYTES + 1:
            return pair
        _powers[size] = pair
    return _powers[size]


def mix(v: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    v = v ^ (v >> np.uint64(32))
    v = v * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xC2B2AE3D27D4EB4F)
    v ^= v >> np.uint64(29)
    return v


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending spans that don't overlap."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + RUN_BYTES, "right")))
        base, top = int(starts[i]), int(ends[j - 1])
        up, down = powers(top - base)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((fold[data[base:top]].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _MULT)
        i = j
    return out


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the given positions as well."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last n-1 are cut off."""
    m = max(0, len(hashes) - n + 1)
    v = hashes[:m].copy()
    for k in range(1, n):
        v = v * _MULT + hashes[k : k + m]
    return mix(v + np.uint64(n))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes, at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of the documents i..j: starts and ends in ``data``, hashes, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NON_SPACE, fold: np.ndarray = LOWER):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = spans(inside[data], offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self._fold = fold

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.starts, self.ends, self._fold)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def each_run(column: pa.Array, inside: np.ndarray = NON_SPACE, fold: np.ndarray = LOWER, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, Words]]:
    data, offsets = strings(column)
    for i, j in runs(offsets, limit):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], inside, fold)


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[k]:bounds[k+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents in order, and n_docs+1 bounds; a document of 1 to n-1 words has one shingle."""
    h = words.hashes()
    full = grams(h, n)
    size = np.where(words.count >= n, words.count - n + 1, np.minimum(words.count, 1))
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    where = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.first[:-1], size)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    where[bounds[short]] = 0
    out = full[where] if len(full) else np.zeros(len(where), np.uint64)
    for d in short:
        out[bounds[d]] = grams(h[words.first[d] : words.first[d + 1]], int(words.count[d]))[0]
    return out, bounds


def map_rows(df, columns: list[str], text: str, schema: str, fn: Callable[[pa.Array], dict[str, pa.Array]]):
    """``columns`` and what ``fn`` makes of the text column, row by row, in Arrow batches; no shuffle.

    A result column takes the place of an input column of its name.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    extra = T._parse_datatype_string(schema)
    kept = [c for c in dict.fromkeys(columns) if c not in extra.names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    out = T.StructType([*(source.schema[c] for c in kept), *extra.fields])
    names = extra.names

    def each(batches):
        for b in batches:
            made = fn(b.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), *(made[n] for n in names)], names=[*kept, *names])
        pa.default_memory_pool().release_unused()  # the worker serves other tasks after this one

    return source.mapInArrow(each, out)


def map_documents(df, text: str, schema: str, fn: Callable[[pa.Array], dict[str, pa.Array]]):
    """All columns of df, whatever their names, as ``__c0``, ``__c1`` ... with what ``fn`` makes of the text."""
    from pyspark.sql import functions as F

    named = df.select(*[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(df.columns)])
    k = df.columns.index(text)
    return map_rows(named.withColumn("__source", F.col(f"__c{k}")), named.columns, "__source", schema, fn)


def restored(mapped, columns: list[str]):
    """The columns of the frame that map_documents() was given."""
    from pyspark.sql import functions as F

    return mapped.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(columns)])
