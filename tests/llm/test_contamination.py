import hashlib
import random
import re
from collections import Counter

import pytest

from tests.llm.cases import empty_documents, sentence, special_documents, table
from vigilar.llm.contamination import contamination_report

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=13):
    patterns = []
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            patterns.append(("" if item_id is None else str(item_id), tuple(w[at : at + n])))
    index = {}
    for item_id, p in patterns:
        index.setdefault(p, set()).add(item_id)
    lengths = {len(p) for p in index}
    out = Counter()
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                owners = index.get(tuple(w[at : at + n]))
                if owners:
                    hit.update(range(at, at + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def check(docs, benchmark):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in contamination_report(docs, benchmark).collect())
    assert got == brute(rows, items)
    return got


def test_given_documents(spark, sf):
    got = check(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    assert sum(k[-1] for k in got) > 0


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, sentence(1, 300)[:200]), (2, "three short words"), (2, "word"), (3, None), (4, ""), (None, sentence(6, 70)), (5, "?!"), (6, sentence(4, 20)), (7, sentence(1, 300)[:200])]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_special_cases(spark, items):
    check(special_documents(spark), items)
    check(special_documents(spark), items.limit(0))
    assert contamination_report(empty_documents(spark), items).collect() == []


def test_items_in_parts(spark, items):
    docs = special_documents(spark)
    whole = Counter(contamination_report(docs, items).collect())
    from vigilar.llm import contamination as C

    found = C.find_contamination(docs, items, part_words=20).withColumn("n_hit", C.hit_words())
    parts = Counter((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"])) for r in found.collect())
    assert parts == Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in whole.elements())


def test_dense_vocabulary(spark):
    """Few words, so that blocks collide and occurrences overlap."""
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(("a", "b", "A.", "c-d")) for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randint(0, 400))) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(r.randint(1, 9))) for i in range(12)] + [(99, text(40))], "item_id long, text string")
    check(docs, items)
