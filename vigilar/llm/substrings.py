"""Exact removal of repeated 100-byte strings, with suffix arrays over blocks that may repeat.

1. Every 100-byte window is owned by its smallest hashed 16-gram (the anchor). Equal windows have
   equal anchors, so only anchors that occur in two different texts, or twice in one, matter.
2. The windows of one anchor place form a block. Equal blocks collapse to the earliest of them;
   all later ones are repeats as a whole. Exact copies of a text are repeats of its first row.
3. Blocks that share an anchor but differ are sorted: q-grams become symbols, a generalised suffix
   array is built by linear grouping (``suffix_groups``), and each interval of common prefixes of
   100 bytes is one repeated string, whose earliest place stays.
4. The blocks of an anchor with more different ones than one task should hold are cut finer
   instead, down to single windows, and compared by content.

Blocks are small and grouped by anchor, so tasks hold ``BLOCK_SYMBOLS`` symbols at a time, whatever
the number of documents. Texts are dealt by document three times: to list blocks, to fetch the
bytes of those that have to be sorted, and to cut out what repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilar.llm import words as W
from vigilar.llm.store import discard, reclaim, saved
from vigilar.llm.suffix_groups import repeated, suffix_array

SPAN = 100
GRAM = 16
SYMBOL = 84  # bytes of a symbol: a window is SPAN - SYMBOL + 1 symbols
HOT_BLOCKS = 4096
HOT_PARTS = (16, 4, 1)
BLOCK_SYMBOLS = 1 << 16
PIECE = 1 << 21


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from running minima of blocks of that size."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the 16-gram) of every anchor place of one array of bytes."""
    n = len(data)
    if n < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    grams = W.window_hash(prefix, GRAM)
    place = _places(grams)
    change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    counts = np.diff(np.concatenate([change, [len(place)]]))
    return change, counts, grams[place[change]]


def _places(grams: np.ndarray) -> np.ndarray:
    """Where the smallest gram of every window starts; of equal ones, the leftmost."""
    low = np.uint64((1 << 24) - 1)
    ranked = grams & ~low
    ranked |= np.arange(len(grams), dtype=np.uint64)
    return (_sliding_min(ranked, SPAN - GRAM + 1) & low).view(np.int64)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a long text that overlap by a window, so that every window is in one piece."""
    for at in range(0, max(1, len(data) - SPAN + 1), PIECE):
        yield at, data[at : at + PIECE + SPAN - 1]


def _text_anchors(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for at, piece in _pieces(data):
        prefix = W.prefix_hash(piece)
        yield at, piece, prefix, *anchors(piece, prefix)


def _slice_anchors(part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text of the slice, anchor hash) of all places, in one go for texts of usual length."""
    if len(part.data) > PIECE:
        found = [np.concatenate([g for *_, g in _text_anchors(part.data[a:b])]) for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True)]
        return np.repeat(np.arange(len(part)), [len(x) for x in found]), np.concatenate(found)
    n = len(part.data)
    if n < SPAN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = W.window_hash(W.prefix_hash(part.data), GRAM)
    place = _places(grams)
    text = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(part.bounds))[: len(place)]
    # Windows that reach into the next text are none.
    whole = np.ones(len(place), dtype=bool)
    for end in part.bounds[1:-1]:
        whole[max(0, end - SPAN + 1) : end] = False
    place, text = place[whole], text[whole]
    first = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])[: len(place)]
    return text[first], grams[place[first]]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, digest of the text), once a text; a gram that a text has twice also comes with another digest."""
    for batch in batches:
        digests = batch.column("_h").to_numpy().view(np.uint64)
        for part in W.slices(batch.column("text")):
            text, grams = _slice_anchors(part)
            if not len(grams):
                continue
            order = np.lexsort((grams, text))
            text, grams = text[order], grams[order]
            again = np.zeros(len(grams), dtype=bool)
            again[1:] = (text[1:] == text[:-1]) & (grams[1:] == grams[:-1])
            digest = digests[part.first + text] ^ again.astype(np.uint64)
            once = np.ones(len(grams), dtype=bool)
            once[2:] = ~(again[2:] & again[1:-1])
            yield pa.RecordBatch.from_arrays([pa.array(grams[once].view(np.int64)), pa.array(digest[once].view(np.int64))], names=["gram", "digest"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the anchors that may repeat: anchor, content, place and number of windows."""
    for batch in batches:
        ids, digests = batch.column("_id").to_numpy(), batch.column("_h").to_numpy()
        lists = batch.column("grams")
        edges, wanted = np.asarray(lists.offsets), np.asarray(lists.values)
        for part in W.slices(batch.column("text")):
            found = []
            for i in range(len(part)):
                row = part.first + i
                own = np.sort(wanted[edges[row] : edges[row + 1]].view(np.uint64))
                if not len(own):
                    continue
                for at, _, prefix, first, count, grams in _text_anchors(part.data[part.bounds[i] : part.bounds[i + 1]]):
                    hit = own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams
                    first, count, grams = first[hit], count[hit], grams[hit]
                    content = W.span_hash(prefix, first, first + count + SPAN - 1)
                    found.append((grams.view(np.int64), content.view(np.int64), np.full(len(first), ids[row]), np.full(len(first), digests[row]), at + first, count))
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["gram", "content", "_id", "_h", "at", "n"])


def _byte_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed blocks of each text."""
    for batch in batches:
        listed = batch.column("blocks").to_pylist()
        ids, digests = batch.column("_id").to_pylist(), batch.column("_h").to_pylist()
        for part in W.slices(batch.column("text")):
            rows = []
            for i in range(len(part)):
                row, text = part.first + i, part.bytes_of(i)
                rows += [(b["gram"], b["different"], ids[row], digests[row], b["at"], b["n"], text[b["at"] : b["at"] + b["n"] + SPAN - 1]) for b in listed[row]]
            if rows:
                kinds = [pa.int64()] * 6 + [pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "different", "_id", "_h", "at", "n", "bytes"])


def _sorted_blocks(group: np.ndarray, ids: np.ndarray, digests: np.ndarray, at: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(_id, _h, window) of the windows of these blocks that also start earlier in a block of the same group."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    counts = np.diff(bounds) - SYMBOL + 1
    block = np.repeat(np.arange(len(texts)), counts)
    offset = W._within(counts)
    starts = bounds[:-1][block] + offset
    grams = W.mix(W.window_hash(W.prefix_hash(data), SYMBOL)[starts] ^ W.mix(group.view(np.uint64))[block])
    _, ranks, often = np.unique(grams, return_inverse=True, return_counts=True)
    unique = often[ranks] == 1
    # A unique symbol ends every repeated string, as the end of a block does: separators of their own, smallest of all.
    ends = np.flatnonzero(np.concatenate([block[1:] != block[:-1], [True]]))
    cut = np.zeros(len(ranks), dtype=bool)
    cut[1:] = unique[1:] & unique[:-1]
    keep = ~cut
    position = np.flatnonzero(keep)
    text_symbols = ranks[position] + len(ranks) * 2
    single = unique[position]
    text_symbols[single] = np.arange(int(single.sum()))
    last = np.zeros(len(ranks), dtype=bool)
    last[ends] = True
    last = last[position]
    insert = np.flatnonzero(last) + 1
    symbols = np.insert(text_symbols, insert, len(ranks) + np.arange(len(insert)))
    position = np.insert(position, insert, -1)
    length = SPAN - SYMBOL + 1
    found, first = repeated(symbols, suffix_array(symbols), length)
    none = np.zeros(0, dtype=np.int64)
    if not len(found):
        return none, none, none
    where = position[found]
    owner = block[where]
    own_id, window = ids[owner], at[owner] + offset[where]
    earliest_id = np.minimum.reduceat(own_id, first)
    interval = np.zeros(len(found), dtype=np.int64)
    interval[first[1:]] = 1
    interval = np.cumsum(interval)
    in_first = own_id == earliest_id[interval]
    earliest_at = np.minimum.reduceat(np.where(in_first, window, np.iinfo(np.int64).max), first)
    later = ~in_first | (window > earliest_at[interval])
    return own_id[later], digests[owner][later], window[later]


def _runs(ids: np.ndarray, digests: np.ndarray, window: np.ndarray) -> pa.RecordBatch | None:
    """Windows joined to byte ranges (_id, _h, start, stop)."""
    if not len(ids):
        return None
    order = np.lexsort((window, digests, ids))
    ids, digests, window = ids[order], digests[order], window[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1]) | (window[1:] > window[:-1] + SPAN)])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:] - 1, [len(ids) - 1]])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[heads], digests[heads], window[heads], window[tails] + SPAN)], names=["_id", "_h", "start", "stop"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that repeat, for blocks that come sorted by anchor; whole anchors are taken together."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def flush(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        if rows:
            group, ids, digests, at, texts = zip(*rows, strict=True)
            found = _runs(*_sorted_blocks(*(np.array(x, dtype=np.int64) for x in (group, ids, digests, at)), list(texts)))
            if found is not None:
                yield found

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "_id", "_h", "at", "bytes")), strict=True):
            if size > BLOCK_SYMBOLS and row[0] != held[-1][0]:
                yield from flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4]) - SYMBOL + 1
    yield from flush(held)


def _sub_blocks(width: int):
    """Cut blocks at every ``width`` windows, counted from the anchor, so that equal windows get the same part number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for gram, own_id, digest, at, n, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "_id", "_h", "at", "n", "bytes")), strict=True):
                prefix = W.prefix_hash(np.frombuffer(text, dtype=np.uint8))
                anchor = int(np.flatnonzero(W.window_hash(prefix, GRAM).view(np.int64) == gram)[0])
                part = np.arange((anchor - n + 1) // width, anchor // width + 1)
                nearest = anchor - part * width  # of the part's windows, the last to start
                first, last = np.maximum(0, nearest - width + 1), np.minimum(n - 1, nearest)
                core = W.span_hash(prefix, nearest, nearest - width + 1 + SPAN)
                content = W.span_hash(prefix, first, last + SPAN)
                rows += [
                    (gram, int(g), int(k), int(c), own_id, digest, at + int(a), int(b - a + 1), text[a : b + SPAN])
                    for g, k, c, a, b in zip(part, core.view(np.int64), content.view(np.int64), first, last, strict=True)
                ]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 8 + [pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "part", "core", "content", "_id", "_h", "at", "n", "bytes"])

    return run


def _refined(blocks: DataFrame) -> DataFrame:
    """Ranges of the windows of hot anchors that also start earlier, by cutting blocks finer and finer.

    The core of a part is what all its windows have in common: where only one block has it, no
    window of the part repeats. Equal parts collapse to the earliest; parts that share a core
    and differ are cut again, down to single windows. No group is held by one task.
    """
    kind = "gram long, part long, core long, content long, _id long, _h long, at long, n long, bytes binary"
    found = None
    for width in HOT_PARTS:
        parts = saved(blocks.select("gram", "_id", "_h", "at", "n", "bytes").mapInArrow(_sub_blocks(width), kind), "parts")
        key = ["gram", "part", "core"]
        shared = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), (F.min("content") < F.max("content")).alias("differ")).where("k > 1")
        place = F.struct("_id", "at", "_h", "n", "bytes")
        firsts = saved(parts.join(shared.drop("k"), key).groupBy(*key, "content", "differ").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("k")), "first_parts")
        lead = firsts.where("k > 1").select(*key, "content", F.struct("f._id", "f.at").alias("lead"))
        later = parts.drop("bytes").join(lead, [*key, "content"]).where(F.struct("_id", "at") > F.col("lead"))
        later = later.select("_id", "_h", F.col("at").alias("start"), (F.col("at") + F.col("n") + SPAN - 1).alias("stop"))
        found = later if found is None else found.unionByName(later)
        blocks = firsts.where("differ").select("gram", "f._id", "f._h", "f.at", "f.n", "f.bytes")
    return found


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(_id, _h, ranges, whole): byte ranges of every document of ``keyed`` that also start earlier.

    ``whole`` marks later rows of a text that an earlier document has as well.
    """
    spark = docs.sparkSession
    digest = F.sha2("text", 256)
    rows = saved(docs.select("_id", "_h", digest.alias("digest"), F.octet_length("text").alias("n_bytes")), "digests")
    firsts = rows.where(F.col("n_bytes") >= SPAN).groupBy("_h", "digest").agg(F.min("_id").alias("first"))
    firsts = saved(firsts, "firsts")
    copies = rows.join(firsts, ["_h", "digest"]).where("_id > first").select("_id", "_h").distinct()

    grams = saved(docs.where(F.octet_length("text") >= SPAN).select("_h", "text").mapInArrow(_anchor_rows, "gram long, digest long"), "anchors")
    shared = grams.groupBy("gram").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("gram")
    wanted = grams.join(shared, "gram").groupBy(F.col("digest").alias("_h")).agg(F.collect_list("gram").alias("grams"))
    wanted = saved(wanted.join(firsts.select("_h", F.col("first").alias("_id")), "_h").select("_id", "_h", "grams"), "wanted")
    discard(grams)
    reclaim(spark)
    kind = "gram long, content long, _id long, _h long, at long, n long"
    texts = docs.select("_id", "_h", "text")
    blocks = texts.join(wanted.hint("shuffle_hash"), ["_id", "_h"]).select("_id", "_h", "text", "grams").mapInArrow(_block_rows, kind)
    blocks = saved(blocks, "blocks")
    discard(wanted)
    reclaim(spark)

    distinct = saved(blocks.groupBy("gram", "content").agg(F.min(F.struct("_id", "at", "_h", "n")).alias("first")), "distinct_blocks")
    lead = distinct.select("gram", "content", F.col("first._id").alias("fid"), F.col("first.at").alias("fat"))
    later = blocks.join(lead, ["gram", "content"]).where((F.col("_id") > F.col("fid")) | (F.col("at") > F.col("fat")) & (F.col("_id") == F.col("fid")))
    later = saved(later.select("_id", "_h", F.col("at").alias("start"), (F.col("at") + F.col("n") + SPAN - 1).alias("stop")), "later_blocks")

    number = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    differing = distinct.join(number, "gram").select("gram", "different", "first._id", "first._h", "first.at", "first.n")
    listed = differing.groupBy("_id", "_h").agg(F.collect_list(F.struct("gram", "different", "at", "n")).alias("blocks"))
    listed = saved(listed, "listed_blocks")
    discard(blocks, distinct)
    reclaim(spark)
    kind = "gram long, different long, _id long, _h long, at long, n long, bytes binary"
    many = texts.join(listed.hint("shuffle_hash"), ["_id", "_h"]).select("_id", "_h", "text", "blocks").mapInArrow(_byte_rows, kind)
    many = saved(many, "differing_blocks")
    discard(listed)
    reclaim(spark)
    sorted_ = many.where(F.col("different") <= HOT_BLOCKS).repartition("gram").sortWithinPartitions("gram", "_id", "at")
    ranges = "_id long, _h long, start long, stop long"
    by_suffix = sorted_.select("gram", "_id", "_h", "at", "bytes").mapInArrow(_suffix_rows, ranges)

    by_part = _refined(many.where(F.col("different") > HOT_BLOCKS))

    found = later.unionByName(by_suffix).unionByName(by_part)
    marks = found.groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")).withColumn("whole", F.lit(False))
    whole = copies.withColumn("ranges", F.array().cast("array<struct<start:long,stop:long>>")).withColumn("whole", F.lit(True))
    marks = saved(marks.unionByName(whole), "marks")
    discard(rows, firsts, later, many)
    reclaim(spark)
    return marks


def _kept(length: int, ranges: list[dict] | None, whole: bool) -> list[tuple[int, int]]:
    """Removed ranges of a text as maximal runs."""
    if whole:
        return [(0, length)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _result_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        ranges, whole = batch.column("ranges").to_pylist(), batch.column("whole").to_pylist()
        for part in W.slices(batch.column("text")):
            for i in range(len(part)):
                text = part.bytes_of(i)
                removed = _kept(len(text), ranges[part.first + i], bool(whole[part.first + i]))
                digest, at = hashlib.sha256(), 0
                for a, b in removed:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in removed), len(removed), digest.hexdigest(), [x for r in removed for x in r]))
        if rows:
            n, gone, runs, digests, spans = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )


def remove_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte ranges) for every row.

    Null and empty texts have no bytes. "Earlier" is a smaller doc_id, or an earlier start in the
    same document; a null doc_id comes last. Rows equal in doc_id and text are one document and
    each give the same result; equal strings of different texts under one doc_id go by their
    starts. An empty table gives an empty result, other columns are ignored.
    """
    W.bounded_batches(docs.sparkSession)
    docs = W.keyed(docs)
    marks = repeated_ranges(docs).groupBy("_id", "_h").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.max("whole").alias("whole"))
    joined = docs.join(marks.hint("shuffle_hash"), ["_id", "_h"], "left").select("doc_id", "text", "ranges", "whole")
    return joined.mapInArrow(_result_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")


# The same in plain SQL, a row per byte; for small tables of distinct doc_ids.
REPEATED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents
), b1 AS (
  SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM d
), b4 AS (
  SELECT doc_id, i, b, b || lead(b) OVER w || lead(b, 2) OVER w || lead(b, 3) OVER w AS s FROM b1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), b20 AS (
  SELECT doc_id, i, b, s || lead(s, 4) OVER w || lead(s, 8) OVER w || lead(s, 12) OVER w || lead(s, 16) OVER w AS s FROM b4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), b100 AS (
  SELECT doc_id, i, b, s || lead(s, 20) OVER w || lead(s, 40) OVER w || lead(s, 60) OVER w || lead(s, 80) OVER w AS s FROM b20 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), first_place AS (
  SELECT s, min((doc_id, i)) AS place FROM b100 WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1
), later AS (
  SELECT b100.doc_id, b100.i FROM b100 JOIN first_place f ON b100.s = f.s AND (b100.doc_id, b100.i) <> f.place
), marked AS (
  SELECT b1.doc_id, b1.i, b1.b,
         coalesce(max(later.i) OVER (PARTITION BY b1.doc_id ORDER BY b1.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), -1) > 0 AS gone
  FROM b1 LEFT JOIN later ON later.doc_id = b1.doc_id AND later.i = b1.i
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM marked
), counted AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
         string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM edges GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN counted USING (doc_id)
"""
