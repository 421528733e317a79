"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is ``WINDOW`` consecutive words of an item (or the whole shorter item). Windows of one
length form a pattern set: blocks of two words index a shift table, which says how far the scan
may move on without passing an occurrence; where the shift is zero, the hash of the suffix block
names a bucket of windows, and the bytes of the words are compared directly.

The scan moves many places of many texts at once: every text is cut into lanes of end positions,
and one step looks up the shifts of all lanes that are still under way.

Items are read in parts of at most ``PART_WORDS`` words. One part's tables are what a task holds
and what is broadcast; further parts are further passes over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilar.llm import words as W
from vigilar.llm.store import saved

WINDOW = 13
PART_WORDS = 200_000
LANE = 256
_K1, _K2 = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)


def _block_keys(before: np.ndarray | None, last: np.ndarray, bits: int) -> np.ndarray:
    mixed = last * _K2 if before is None else before * _K1 + last * _K2
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class PatternSet:
    """Windows of one length, with their shift table and suffix buckets."""

    length: int
    texts: list[bytes]
    symbols: np.ndarray  # (windows, length) word hashes
    bits: int = 0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint8))
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def __post_init__(self) -> None:
        n, m = self.symbols.shape
        self.bits = max(12, min(24, int(n * m * 16).bit_length()))
        block = min(2, m)
        self.shift = np.full(1 << self.bits, m - block + 1, dtype=np.uint8)
        for end in range(block - 1, m):
            keys = _block_keys(self.symbols[:, end - 1] if block == 2 else None, self.symbols[:, end], self.bits)
            np.minimum.at(self.shift, keys, np.uint8(m - 1 - end))
        suffix = _block_keys(self.symbols[:, -2] if block == 2 else None, self.symbols[:, -1], self.bits)
        self.order = np.argsort(suffix, kind="stable")
        self.keys = suffix[self.order]

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """End positions at which some window may end."""
        m = self.length
        first, last = bounds[:-1] + m - 1, bounds[1:]
        lanes = np.maximum(0, -(-(last - first) // LANE))
        offset = W._within(lanes) * LANE
        pos = np.repeat(first, lanes) + offset
        stop = np.minimum(pos + LANE, np.repeat(last, lanes))
        found = []
        while len(pos):
            keys = _block_keys(h[pos - 1] if m > 1 else None, h[pos], self.bits)
            step = self.shift[keys]
            found.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            going = pos < stop
            pos, stop = pos[going], stop[going]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def matches(self, h: np.ndarray, ends: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """(end, window) of all occurrences among the candidate ends, by direct comparison."""
        m = self.length
        keys = _block_keys(h[ends - 1] if m > 1 else None, h[ends], self.bits)
        at, stop = np.searchsorted(self.keys, keys, side="left"), np.searchsorted(self.keys, keys, side="right")
        out_ends, out_windows = [], []
        while len(ends):
            more = at < stop
            ends, at, stop = ends[more], at[more], stop[more]
            window = self.order[at]
            same = (h[ends - m + 1] == self.symbols[window, 0]) & (h[ends] == self.symbols[window, -1])
            e, w = ends[same], window[same]
            equal = np.fromiter((text_of(x - m + 1, x) == self.texts[y] for x, y in zip(e, w, strict=True)), dtype=bool, count=len(e))
            out_ends.append(e[equal])
            out_windows.append(w[equal])
            at = at + 1
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(out_ends), np.concatenate(out_windows)) if out_ends else (none, none)


@dataclass
class Part:
    """Pattern sets of some items; ``owners[k][w]`` are the ids of the items with window w of set k."""

    sets: list[PatternSet]
    owners: list[list[tuple[str, ...]]]


def _build(items: list[tuple[str, bytes]], window: int) -> Part:
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = defaultdict(dict)
    for item_id, text in items:
        part = W.Slice(0, np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])).lowered()
        words = part.words(W.ALNUM)
        hashes = words.hashes()
        tokens = [part.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
        size = min(window, len(tokens))
        for at in range(len(tokens) - size + 1 if size else 0):
            text = b" ".join(tokens[at : at + size])
            by_length[size].setdefault(text, (hashes[at : at + size], set()))[1].add(item_id)
    sets, owners = [], []
    for size, found in sorted(by_length.items()):
        sets.append(PatternSet(size, list(found), np.array([h for h, _ in found.values()])))
        owners.append([tuple(sorted(ids)) for _, ids in found.values()])
    return Part(sets, owners)


def _parts(benchmark: DataFrame, window: int, part_words: int) -> Iterator[Part]:
    item_id = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    rows = benchmark.select(item_id.alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    waiting: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        text = row["t"].encode()
        waiting.append((row["i"], text))
        size += len(text) // 2 + 1  # at most so many words
        if size >= part_words:
            yield _build(waiting, window)
            waiting, size = [], 0
    if waiting:
        yield _build(waiting, window)


def _joined_words(words: W.Words, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of a slice with one space before each, and the start of each word there."""
    lengths = words.ends - words.starts
    starts = np.cumsum(lengths + 1) - lengths
    out = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
    out[np.repeat(starts, lengths) + W._within(lengths)] = words.of.data[inside]
    return out, starts


def _search(part_of, names: list[str]):
    """mapInArrow function: adds the occurrences of one part to n_words, spans and items of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Part = part_of.value
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            spans: list[list[int]] = batch.column("spans").to_pylist()
            items: list[list[str]] = batch.column("items").to_pylist()
            for piece in W.slices(batch.column("text")):
                piece = piece.lowered()
                words = piece.words(W.ALNUM)
                counts[piece.first : piece.first + len(piece)] = words.counts()
                h = words.hashes()
                joined = starts = None
                edges = np.zeros(len(h) + 1, dtype=np.int64)
                any_hit = False
                for patterns, owners in zip(part.sets, part.owners, strict=True):
                    ends = patterns.candidates(h, words.bounds)
                    if not len(ends):
                        continue
                    if joined is None:
                        joined, starts = _joined_words(words, W.ALNUM[piece.data])
                    width = words.ends - words.starts

                    def text_of(a: int, b: int, joined=joined, starts=starts, width=width) -> bytes:
                        return joined[starts[a] : starts[b] + width[b]].tobytes()

                    e, w = patterns.matches(h, ends, text_of)
                    if len(e):
                        any_hit = True
                        np.add.at(edges, e - patterns.length + 1, 1)
                        np.add.at(edges, e + 1, -1)
                        doc = np.searchsorted(words.bounds, e, side="right") - 1
                        for i, k in {(int(i), int(k)) for i, k in zip(doc, w, strict=True)}:
                            items[piece.first + i].extend(owners[k])
                if any_hit:
                    covered = np.cumsum(edges[:-1]) > 0
                    for i in range(len(piece)):
                        own = covered[words.bounds[i] : words.bounds[i + 1]]
                        if own.any():
                            turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                            spans[piece.first + i].extend(int(x) for x in turns)
            kept = {name: batch.column(name) for name in names}
            kept["n_words"] = pa.array(counts)
            kept["spans"] = pa.array([_merged(s) for s in spans], pa.list_(pa.int32()))
            kept["items"] = pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(kept, schema=pa.schema([batch.schema.field(x) for x in names]))

    return run


def _merged(spans: list[int]) -> list[int]:
    """Union of half-open ranges given as start, end, start, end, ..."""
    if len(spans) < 4:
        return spans
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, n_words, spans (word ranges that windows cover) and items for every row of ``docs``.

    Null and blank texts have no words; null and blank items have no windows. Repeated rows
    each give a row. An empty benchmark leaves every document clean, an empty table gives an
    empty result. Other columns, whatever their names, are left behind.
    """
    spark = docs.sparkSession
    W.bounded_batches(spark)
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")]
    out = docs.select(*carried, text.alias("text"), *none)
    result = [c for c in out.columns if c != "text"]
    parts = _parts(benchmark, window, part_words)
    part = next(parts, Part([], []))
    while part is not None:
        following = next(parts, None)
        names = result if following is None else out.columns
        searched = out.select(*names).schema
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(part), names), searched)
        if following is not None:
            out = saved(out, "searched")
        part = following
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "n_words", "spans", "items")


def hit_words() -> Column:
    """Words inside spans, of a row of ``find_contamination``."""
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    found = find_contamination(docs, benchmark).withColumn("n_hit", hit_words())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


# The same in plain SQL, for tables small enough for it.
REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT m FROM item_windows
), doc_windows AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)
), hit AS (
  SELECT r, i, m, item_id FROM doc_windows JOIN item_windows USING (m, g)
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
