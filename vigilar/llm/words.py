"""Whole Arrow batches of texts as byte arrays: words, hashes and sets without a loop per word.

Texts stay UTF-8 bytes. A batch is cut into slices of about ``SLICE_BYTES`` between texts,
so that memory is bounded by the slice or the longest text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
MAX_BATCH_BYTES = 32 << 20
MAX_ID = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


# Bytes of words: all but space, tab and line breaks; and letters, digits and non-ASCII bytes.
NOT_SPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = _class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def bounded_batches(spark: SparkSession) -> None:
    """Limit the bytes of an Arrow batch, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MAX_BATCH_BYTES))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, text and ``more``, with ``_id`` (a null doc_id sorts last) and ``_h`` (hash of the text).

    ``_id`` and ``_h`` together name a row: rows that share both are the same document.
    Other columns of the input, whatever their names, are left behind.
    """
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(MAX_ID)).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"), *more)


def same_row(a: str, b: str) -> Column:
    return (F.col(f"{a}._id") == F.col(f"{b}._id")) & (F.col(f"{a}._h") == F.col(f"{b}._h"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers_cache: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _powers_cache.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, _BASE_INV if inverse else _BASE, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers_cache[key] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``out[j] - out[i]`` is the polynomial hash of ``data[i:j]`` times the i-th power of the base."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts] + (ends - starts).astype(np.uint64))


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of all runs of ``size`` bytes, in order."""
    count = max(0, len(prefix) - size)
    out = prefix[size:] - prefix[:count]
    out *= powers(len(prefix), inverse=True)[:count]
    out += np.uint64(size)
    return mix(out)


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    """``prefix_hash`` over words instead of bytes."""
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=out[1:])
    return out


def context_hashes(prefix: np.ndarray, ends: np.ndarray, k: int, text: np.ndarray) -> np.ndarray:
    """Hashes of the k words that end at each of the words ``ends``, different in different texts.

    ``prefix`` comes from ``word_prefix``, ``text`` numbers the text of every word.
    """
    return span_hash(prefix, ends - k + 1, ends + 1) ^ mix(text[ends].astype(np.uint64) + np.uint64(k))


@dataclass
class Slice:
    """Some consecutive texts of a batch. ``bounds`` has one more entry than there are texts."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def lowered(self) -> Slice:
        return Slice(self.first, LOWER[self.data], self.bounds)

    def words(self, member: np.ndarray) -> Words:
        inside = member[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.bounds] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.bounds))


@dataclass
class Words:
    """Words of a slice; text i has the words ``bounds[i]:bounds[i + 1]``."""

    of: Slice
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self, prefix: np.ndarray | None = None) -> np.ndarray:
        return span_hash(prefix_hash(self.of.data) if prefix is None else prefix, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets.astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if not len(column):
        return
    data, offsets = column_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def shingle_hashes(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their bounds per text.

    A text of fewer words, but not none, gives the one hash of its whole sequence.
    """
    h = words.hashes() if hashes is None else hashes
    n, bounds = len(h), words.bounds
    counts = np.diff(bounds)
    out = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for j in range(size):
        out += h[j : j + len(out)] * powers(size + 1)[j + 1]
    out = mix(out + np.uint64(size))
    full = np.maximum(counts - size + 1, 0)
    new_bounds = np.concatenate([[0], np.cumsum(np.where((counts > 0) & (counts < size), 1, full))])
    result = np.empty(new_bounds[-1], dtype=np.uint64)
    starts = np.repeat(bounds[:-1], full) + _within(full)
    result[np.repeat(new_bounds[:-1], full) + _within(full)] = out[starts]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[bounds[i] : bounds[i + 1]]
        total = (own * powers(size + 1)[1 : len(own) + 1]).sum(dtype=np.uint64)
        result[new_bounds[i]] = mix(np.array([total + np.uint64(len(own))], dtype=np.uint64))[0]
    return result, new_bounds


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
