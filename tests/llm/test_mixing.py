import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty_documents, special_documents, table
from vigilar.llm.mixing import BLOCK, draw_counts, draw_slots, mix_sources, packed_mix, permuted, target_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by reopening the shares round by round; sizes by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            fixed |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            fixed[s] = float(most * sizes[s])
            free.discard(s)
        left = sum(sizes.values()) - sum(fixed.values())
    return fixed


def check(docs):
    given = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    rows = mix_sources(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter(given)
    sizes = defaultdict(int)
    for _, n, s in given:
        sizes[s] += n
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(2 * BLOCK, 0.02 * t), (s, taken[s], t)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mix_sources(docs.repartition(5)).collect()))


def test_given_documents(spark, sf):
    check(table(spark, sf, "documents"))


def test_special_cases(spark):
    check(special_documents(spark))
    assert mix_sources(empty_documents(spark)).collect() == []


def test_only_blank_texts(spark):
    docs = spark.createDataFrame([(1, " ", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix_sources(docs).collect()] == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1023])
def test_permutation(spark, n):
    frame = spark.range(n).select(*[permuted(F.col("id"), F.lit(n).cast("long"), F.lit(s), F.lit(0).cast("long")).alias(f"p{s}") for s in range(3)])
    columns = list(zip(*frame.collect(), strict=True))
    assert all(sorted(c) == list(range(n)) for c in columns)
    assert n < 50 or len(set(columns)) == 3


def test_counts_of_shards_are_multinomial(spark):
    """Chi-square of the source counts of every shard, and of each source over its shards."""
    rows = spark.createDataFrame([(i, f"s{i % 4}", 1000) for i in range(400)], "doc_id long, source string, size long")
    targets = target_table(rows)
    counts = draw_counts(targets, block=10, shard_slots=500).collect()
    totals, of_shard = Counter(), defaultdict(Counter)
    for r in counts:
        totals[r["s"]] += r["slots"]
        of_shard[r["shard"]][r["s"]] = r["slots"]
    shards, total = -(-sum(totals.values()) // 500), sum(totals.values())
    assert set(of_shard) == set(range(shards)) and shards > 50
    for s, n in totals.items():
        chi = sum((of_shard[k][s] - n / shards) ** 2 / (n / shards) for k in range(shards))
        assert abs(chi - (shards - 1)) < 4 * (2 * (shards - 1)) ** 0.5, (s, chi)
    for k in range(shards):
        size = sum(of_shard[k].values())
        chi = sum((of_shard[k][s] - size * n / total) ** 2 / (size * n / total) for s, n in totals.items())
        assert chi < 25, (k, chi)  # three degrees of freedom: once in 60,000
    # Slots follow from the counts: each once, in the stretch of its shard, none of the blocks more than three times.
    slots = draw_slots(targets, block=10, shard_slots=500).collect()
    assert Counter((r["shard"], r["s"]) for r in slots) == Counter({(r["shard"], r["s"]): r["slots"] for r in counts})
    assert len({(r["s"], r["slot"]) for r in slots}) == total
    assert max(Counter((r["s"], r["block"]) for r in slots).values()) <= 3


def test_the_plan_of_the_query_holds_the_draw(spark, sf):
    """The shards of the result come from the drawn counts, and the packed mix adds up to what is taken."""
    docs = table(spark, sf, "documents")
    taken = mix_sources(docs, shard_slots=64)
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "min(shard" in plan and "max(shard" in plan
    rows = {r["doc_id"]: r for r in taken.collect()}
    words, shards = Counter(), defaultdict(set)
    for r in packed_mix(docs, shard_slots=64).collect():
        assert 0 <= r["first_word"] < rows[r["doc_id"]]["size"] and r["words"] <= BLOCK
        words[r["doc_id"]] += r["words"]
        shards[r["doc_id"]].add(r["shard"])
    for i, r in rows.items():
        assert words[i] == r["taken"] and (r["first_shard"], r["last_shard"]) == ((min(shards[i]), max(shards[i])) if i in shards else (None, None))
    assert len({s for x in shards.values() for s in x}) > 20
