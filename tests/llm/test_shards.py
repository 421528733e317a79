import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import empty_documents, special_documents, table
from vigilar.llm import shards
from vigilar.llm.shards import _fits, assign_shards, minimax_cuts


def check(docs, n=40):
    rows = assign_shards(docs, n).collect()
    assert len(rows) == docs.count()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    slots, place = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        place[(r["text_crc32"], r["size"])].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in place.values())
    return rows


def test_given_documents(spark, sf):
    rows = check(table(spark, sf, "documents"))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, assign_shards(table(spark, sf, "documents")).collect()))


def test_special_cases(spark):
    check(special_documents(spark))
    check(special_documents(spark), 3)
    assert assign_shards(empty_documents(spark)).collect() == []


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_PER_RANK", 50)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    rows = check(docs)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    rest = sorted(sizes.values())[:-1]
    assert max(rest) - min(rest) < 0.1 * max(rest)


def best_capacity(sizes, n):
    from functools import cache

    @cache
    def best(at, k):
        if at == len(sizes):
            return 0
        if not k:
            return float("inf")
        return min(max(sum(sizes[at:j]), best(j, k - 1)) for j in range(at + 1, len(sizes) + 1))

    return best(0, n)


@given(st.lists(st.integers(1, 40), max_size=12), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_minimax(sizes, n):
    capacity, cuts = minimax_cuts(np.array(sizes, dtype=np.int64), n)
    assert capacity == best_capacity(tuple(sizes), n)
    bounds = [0, *cuts]
    assert len(cuts) <= n and (not sizes or bounds[-1] == len(sizes))
    assert all(0 < sum(sizes[a:b]) <= capacity for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    if sizes and capacity > 1:
        assert _fits(np.cumsum(sizes), capacity - 1, n) is None
