import hashlib
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.llm.cases import empty_documents, sentence, special_documents, table
from vigilar.llm.periodic_runs import find_runs, later_periods, periodic_runs, run_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every lag compared word by word; a stretch counts for its smallest lag."""
    words, n, out = np.array(words), len(words), {}
    for q in range(1, n // 4 + 1):
        same = np.append(words[q:] == words[:-q], False)
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            elif not x and start is not None:
                length = i - start + q
                if length >= max(6, 4 * q):
                    inner = words[start : start + q].tolist()
                    if not any(q % d == 0 and inner == inner[:d] * (q // d) for d in range(1, q)):
                        out[(start, length)] = q
                start = None
    return sorted((s, length, q) for (s, length), q in out.items())


def brute(doc_id, text):
    words = WORD.findall(text or "")
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = Counter(map(tuple, run_report(docs).collect()))
    assert got == Counter(brute(*r) for r in rows)
    return got


def test_given_documents(spark, sf):
    got = check(table(spark, sf, "documents"))
    assert sum(1 for r in got if r[1]) >= 10


def test_special_cases(spark):
    check(special_documents(spark).where("doc_id <> 13 or doc_id is null"))
    assert run_report(empty_documents(spark)).collect() == []
    assert run_report(empty_documents(spark)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("seed", range(30))
def test_words_of_small_alphabets(seed):
    """Several texts at once, with nested and overlapping runs."""
    r = random.Random(seed)
    texts = []
    for _ in range(6):
        words = []
        while len(words) < r.choice([5, 40, 150]):
            piece = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.choice([1, 1, 2, 3, 5, 7, 11]))]
            words += (piece * r.choice([1, 2, 4, 5, 9]))[: r.choice([3, 20, 60])]
            if r.random() < 0.2:
                words = words * r.choice([2, 4, 5])
        texts.append(words[:600])
    hashes = np.random.default_rng(seed).integers(0, 1 << 63, 20).astype(np.uint64)
    bounds = np.cumsum([0, *map(len, texts)])
    start, length, period = find_runs(hashes[np.concatenate([np.array(t, dtype=int) for t in texts])], bounds)
    want = [(s + bounds[i], m, q) for i, t in enumerate(texts) for s, m, q in brute_runs(t)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == sorted(want, key=lambda x: (x[0], x[2]))


def test_long_and_repetitive_texts(spark):
    """A text of one word, one of a long period, and one of ordinary words, each of many words, within seconds."""
    many = 400_000
    period = sentence(5, 50_000)
    rows = [(1, "word " * many), (2, f"{period} " * 5), (4, sentence(9, many)), (5, "a b " * (many // 2) + "c")]
    began = time.time()
    got = {r["doc_id"]: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert time.time() - began < 60
    as_tuples = {k: [tuple(x) for x in r["runs"]] for k, r in got.items()}
    assert as_tuples[1] == [(0, many, 1)] and got[1]["collapsed"] == "word"
    assert (0, 250_000, 50_000) in as_tuples[2]
    assert as_tuples[5] == [(0, many, 2)] and got[5]["collapsed"] == "a b c"


def test_dropped_words_come_after_a_first_period():
    assert later_periods((np.array([2]), np.array([8]), np.array([2])), 12).tolist() == [False] * 4 + [True] * 6 + [False] * 2
