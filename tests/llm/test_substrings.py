import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import empty_documents, sentence, special_documents, table
from vigilar.llm import substrings
from vigilar.llm.substrings import remove_repeated
from vigilar.llm.suffix_groups import repeated, suffix_array

SPAN = 100


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of every row, window by window."""
    order = sorted({(float("inf") if i is None else i, (t or "").encode()) for i, t in rows})
    first = {}
    for i, text in order:
        for at in range(len(text) - SPAN + 1):
            w = text[at : at + SPAN]
            first[w] = min(first.get(w, (i, at)), (i, at))
    out = Counter()
    for i, t in rows:
        text = (t or "").encode()
        own = float("inf") if i is None else i
        gone = bytearray(len(text))
        for at in range(len(text) - SPAN + 1):
            if first[text[at : at + SPAN]] < (own, at):
                gone[at : at + SPAN] = b"\1" * SPAN
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[(i, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in remove_repeated(docs).collect())
    assert got == brute(rows)


def test_given_documents(spark, sf):
    check(table(spark, sf, "documents"))


def test_special_cases(spark):
    check(special_documents(spark).where("doc_id <> 13 or doc_id is null"))
    assert remove_repeated(empty_documents(spark)).collect() == []


def mixed_documents(spark):
    r = random.Random(5)
    passages = [sentence(50 + k, 40) for k in range(4)] + ["ab" * 90, "x" * 130]
    rows = []
    for i in range(80):
        parts = [sentence(500 + i * 7 + k, r.randint(1, 30)) for k in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 40)
            parts.insert(r.randint(0, len(parts)), p[a : len(p) - r.randint(0, 20)])
        rows.append((i, "".join(parts)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_overlapping_and_periodic_repeats(spark):
    check(mixed_documents(spark))


def test_anchors_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_BLOCKS", 2)
    check(mixed_documents(spark))


def test_pieces_of_long_texts(monkeypatch):
    data = np.frombuffer(sentence(3, 3000).encode(), dtype=np.uint8)
    whole = sorted(g for *_, first, count, grams in substrings._text_anchors(data) for g in np.repeat(grams, count).tolist())
    monkeypatch.setattr(substrings, "PIECE", 777)
    parts = sorted(g for *_, first, count, grams in substrings._text_anchors(data) for g in np.repeat(grams, count).tolist())
    assert whole == parts and len(whole) == len(data) - SPAN + 1


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols):
    got = suffix_array(np.array(symbols, dtype=np.int64)).tolist()
    assert got == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@given(st.lists(st.integers(0, 2), min_size=1, max_size=50), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_repeated_intervals(symbols, length):
    text = np.array(symbols, dtype=np.int64)
    found, first = repeated(text, suffix_array(text), length)
    want = Counter(tuple(symbols[i : i + length]) for i in range(len(symbols) - length + 1))
    assert sorted(found.tolist()) == [i for i in range(len(symbols) - length + 1) if want[tuple(symbols[i : i + length])] > 1]
    assert len(first) == sum(1 for n in want.values() if n > 1)
