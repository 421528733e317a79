"""Shards of near-equal bytes: a minimax contiguous partition of ordered atomic groups.

Texts are dealt into ``CELLS`` cells by a hash. The cells, in order, are the atomic groups: equal
texts always share one. Their sizes, a table of at most ``CELLS`` rows however many documents
there are, come to the driver; a binary search finds the smallest capacity with which a greedy
walk needs no more than the given shards. Within that capacity the cuts are moved to places near
equal shares, so that a group larger than a share does not leave other shards full and the last
ones empty; where that is not possible, the cuts of the walk stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
CELLS = 1 << 17
OVERHEAD = 16
ROWS_PER_RANK = 4096


def _fits(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (exclusive group indices) with at most ``capacity`` a shard, or None."""
    cuts, start, done = [], 0, 0
    while start < len(ends):
        if len(cuts) == shards:
            return None
        stop = int(np.searchsorted(ends, done + capacity, side="right"))
        if stop == start:
            return None
        cuts.append(stop)
        start, done = stop, int(ends[stop - 1])
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity for ordered groups of these sizes, and its greedy cuts."""
    if not len(sizes):
        return 0, []
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _fits(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    even = _even_cuts(sizes, shards)
    sums = np.diff(np.concatenate([[0], ends[np.array(even) - 1]])) if even else []
    return low, even if even and max(sums) <= low else _fits(ends, low, shards)


def _even_cuts(sizes: np.ndarray, shards: int) -> list[int] | None:
    """Cuts near equal shares, with every group above a share in a shard of its own; None if shards run out."""
    share = sizes.sum() / shards
    large = np.flatnonzero(sizes > share)
    edges = np.unique(np.concatenate([[0, len(sizes)], large, large + 1]))
    runs = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    small = [r for r in runs if not (r[1] - r[0] == 1 and sizes[r[0]] > share)]
    left = shards - (len(runs) - len(small))
    if left < len(small):
        return None
    sums = {r: int(sizes[r[0] : r[1]].sum()) for r in small}
    number = {r: 1 for r in small}
    for _ in range(left - len(small)):  # the next shard goes where shards are largest
        r = max((r for r in small if number[r] < r[1] - r[0]), key=lambda r: sums[r] / number[r], default=None)
        if r is not None:
            number[r] += 1
    cuts = []
    for a, b in runs:
        ends = np.cumsum(sizes[a:b])
        start, done = 0, 0
        for k in range(number.get((a, b), 1), 0, -1):
            goal = done + (int(ends[-1]) - done) / k
            stop = int(np.searchsorted(ends, goal)) + 1
            if stop > start + 1 and goal - ends[stop - 2] < ends[min(stop, len(ends)) - 1] - goal:
                stop -= 1
            start = min(max(stop, start + 1), len(ends) - (k - 1))
            done = int(ends[start - 1])
            cuts.append(a + start)
    return cuts


def assign_shards(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    Size is the UTF-8 bytes of the text plus 16; a null text has no bytes and counts as an
    empty one. Equal texts share a shard, repeated rows each get a slot of their own, and a
    null doc_id comes last among equal texts. Slots count from 0 without gaps in every shard. If the
    groups end early (few, or one of most bytes), later shards stay empty. The law is `bytes`.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    own = F.xxhash64(text)
    rows = docs.select(
        *carried,
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(own, F.lit(cells)).cast("int").alias("cell"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("o"),
        own.alias("h"),
    )
    held = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()
    _, cuts = minimax_cuts(held["size"].to_numpy(dtype=np.int64), shards)
    shard = np.repeat(np.arange(len(cuts)), np.diff([0, *cuts])).astype(np.int32)
    n = held["n"].to_numpy(dtype=np.int64)
    before = np.cumsum(n) - n
    if len(cuts):
        before -= before[np.concatenate([[0], cuts[:-1]]).astype(int)][shard]
    plan = held.assign(shard=shard, before=before, parts=-(-n // ROWS_PER_RANK))[["cell", "shard", "before", "parts"]]
    plan = docs.sparkSession.createDataFrame(plan, "cell int, shard int, before long, parts long")

    # A cell with many rows (copies) is ranked in parts; the rows of all parts before are added.
    dealt = rows.join(F.broadcast(plan), "cell").withColumn("part", F.pmod(F.xxhash64("o", "size"), "parts"))
    totals = dealt.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("k"))
    ahead = F.sum("k").over(Window.partitionBy("cell").orderBy("part")) - F.col("k")
    totals = totals.select("cell", "part", ahead.alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("h", "o"))
    out = dealt.withColumn("rank", rank.cast("long") - 1).join(totals, ["cell", "part"])
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("ahead") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
