"""The mix stage keeps the words of every source near its target."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_mixing import WORD, brute_targets


def documents(spark):
    """A hot source (s2) of weight 1 with more than one bucket, and small ones; some documents are long."""
    rows = []
    for source, n in (("s0", 2500), ("s1", 900), ("s2", 5000), ("s3", 2000), ("s4", 800), ("s5", 700)):
        for i in range(n):
            words = 900 if i % 50 == 7 else 20 + 37 * i % 150
            rows.append((len(rows), f"{source} {i} " + "w " * words, "en", source, 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_words_of_sources_follow_targets(spark, sf):
    docs = documents(spark)
    given, got, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        n = len(WORD.findall(r["text"]))
        given[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    targets = brute_targets(given)
    out = corpus_pipeline.mix(spark, docs, sf).collect()
    times = Counter(r["doc_id"] for r in out)
    assert max(times.values()) <= 3
    long_ones = defaultdict(int)
    for r in out:
        n = len(WORD.findall(r["text"]))
        got[r["source"]] += n
        long_ones[r["source"]] += n > 800
    assert min(targets[s] / given[s] for s in given) < 0.4  # where rounding document by document keeps next to none
    for s in given:
        assert abs(got[s] - targets[s]) <= longest[s] + 128, (s, got[s], targets[s])
    assert long_ones["s2"] >= 0.5 * 100 * targets["s2"] / given["s2"]


def test_repeated_and_missing_ids(spark, sf):
    rows = [(None if i % 2 else 7, f"text {i % 3} " + "w " * 40, "en", "b", 1) for i in range(60)]
    rows += [(1000 + i, f"other {i} " + "w " * 40, "en", "a", 1) for i in range(60)] + [(5000 + i, f"more {i} " + "w " * 40, "en", "c", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given, got = defaultdict(int), defaultdict(int)
    for r in rows:
        given[r[3]] += len(WORD.findall(r[1]))
    for r in corpus_pipeline.mix(spark, docs, sf).collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    for s, target in brute_targets(given).items():
        assert abs(got[s] - target) <= 42 + 128, (s, got[s], target)
