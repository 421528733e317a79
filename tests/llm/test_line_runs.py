import hashlib
import re
import time
from collections import Counter

import duckdb
import pytest

from tests.llm.cases import empty_documents, sentence, special_documents, table
from vigilar.llm.line_runs import REPORT_SQL, line_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least=50):
    """All runs of lines of at least ``least`` words that start earlier as well, found run by run."""
    texts = {}
    for i, t in rows:
        texts[(float("inf") if i is None else i, t or "")] = [x for x in (t or "").split("\n") if WORD.search(x)]
    first, runs = {}, []
    for key, lines in texts.items():
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(WORD.findall(lines[b]))
                run = (tuple(lines[a : b + 1]), key, a, b)
                if words >= least:
                    runs.append(run)
                    first[run[0]] = min(first.get(run[0], (key[0], a)), (key[0], a))
                    if words >= 3 * least:
                        break
    gone = {k: set() for k in texts}
    for content, key, a, b in runs:
        if first[content] < (key[0], a):
            gone[key].update(range(a, b + 1))
    out = Counter()
    for i, t in rows:
        key = (float("inf") if i is None else i, t or "")
        lines, g = texts[key], gone[key]
        kept = "\n".join(x for k, x in enumerate(lines) if k not in g)
        out[(i, len(lines), len(g), sum(1 for k in g if k - 1 not in g), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256")) for r in line_report(docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    frame = line_report(table(spark, folder, "documents"))
    names = frame.columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({REPORT_SQL})").fetchall()
    assert Counter(map(tuple, frame.collect())) == Counter(want)
    assert sum(r[names.index("n_removed")] for r in want) > 0


def test_special_cases(spark):
    check(special_documents(spark).where("doc_id <> 13 or doc_id is null"))
    assert line_report(empty_documents(spark)).collect() == []


def test_runs_of_short_lines(spark):
    passage = [sentence(k, 1 + k % 4) for k in range(60)]
    rows = []
    for i in range(40):
        a, b = (7 * i) % 30, 30 + (11 * i) % 30
        rows.append((i, "\n".join([sentence(900 + i, 5), *passage[a:b], "", " ", sentence(800 + i, 30), passage[3], *passage[40 - i % 5 :]])))
    rows += [(100, "\n".join(["same line"] * 80)), (101, "\n".join(["same line"] * 90))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_very_long_texts(spark):
    """Texts of 60,000 lines of one word that are copies of each other take seconds, not lines times removed lines."""
    lines = [f"w{i}" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(["own", *lines[10_000:30_000], "other"]))]
    began = time.time()
    got = {r["doc_id"]: r for r in line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert time.time() - began < 120
    assert [(got[i]["n_lines"], got[i]["n_removed"], got[i]["n_runs"]) for i in (1, 2, 3)] == [(60_000, 0, 0), (60_000, 60_000, 1), (20_002, 20_000, 1)]
    assert got[3]["kept_sha256"] == hashlib.sha256(b"own\nother").hexdigest() and got[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
