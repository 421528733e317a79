import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import BASE, empty_documents, sentence, special_documents, table
from vigilar.llm import words as W
from vigilar.llm.components import components
from vigilar.llm.near_duplicates import minima, near_duplicate_groups

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute(rows):
    """{(doc_id, text): (n_shingles, component_id)}, linking every pair that is similar enough."""
    sets = [shingles(t) for _, t in rows]
    key = [float("inf") if i is None else i for i, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            found[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in found[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), float("inf")), key[i])
    return {r: (len(sets[i]), least[root(i)]) for i, r in enumerate(rows)}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, n, None if c == float("inf") else c) for (i, t) in rows for n, c in [brute_of[(i, t)]]) if (brute_of := brute(rows)) else Counter()
    got = near_duplicate_groups(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_given_documents(spark, sf):
    check(table(spark, sf, "documents"))


def test_special_cases(spark):
    check(special_documents(spark))
    assert near_duplicate_groups(empty_documents(spark)).collect() == []


def test_large_group_of_near_copies(spark):
    """Copies of copies: links to the smallest document alone would miss most."""
    rows, text = [], BASE.split()
    for i in range(400):
        text = list(text)
        text[(7 * i) % 300] = f"w{i}"
        rows.append((1000 + i, " ".join(text)))
    rows += [(i, sentence(i, 200)) for i in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = minima(values[:2000]), minima(values[500:2500])
    assert abs((a == b).mean() - 1500 / 2500) < 0.12


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)], [(7, i) for i in range(8, 60)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: i for e in edges for i in e}
    for _ in range(len(want)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_slices_do_not_change_hashes():
    import pyarrow as pa

    texts = pa.array(["one two three four five six", None, "", "a b", "x" * 50 + " y z"])
    hashes = [[int(h) for part in W.slices(texts, size) for h in W.shingle_hashes(part.words(W.NOT_SPACE), 5)[0]] for size in (1, 30, 10_000)]
    assert hashes[0] == hashes[1] == hashes[2]
