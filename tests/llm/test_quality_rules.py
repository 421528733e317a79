import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty_documents, sentence, special_documents, table
from vigilar.llm.quality_rules import LEAST_FINE, MEASURES, ROUNDS, RULES, fit_rules, rule_report, weigh_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def brute_failed(m):
    return m[0] < 10 or 100 * m[4] > 20 * m[0]


def brute_em(cast):
    """The posterior of every document, vote by vote and document by document."""
    k = len(RULES)
    fine, bad, share = [0.98] * k, [0.6] * k, 0.9

    def posterior(v):
        z = math.log(share / (1 - share))
        for j in range(k):
            if v[j] == 1:
                z += math.log(fine[j] / (1 - bad[j]))
            elif v[j] == -1:
                z += math.log((1 - fine[j]) / bad[j])
        return 1 / (1 + math.exp(-max(-50, min(50, z))))

    for _ in range(ROUNDS if cast else 0):
        p = [posterior(v) for v in cast]
        new_fine, new_bad = [], []
        for j in range(k):
            voted = [(x, v[j]) for x, v in zip(p, cast, strict=True) if v[j]]
            f = (sum(x for x, y in voted if y == 1) + 49) / (sum(x for x, _ in voted) + 50)
            b = (sum(1 - x for x, y in voted if y == -1) + 0.6) / (sum(1 - x for x, _ in voted) + 1)
            new_fine.append(min(0.999, max(LEAST_FINE, f)))
            new_bad.append(min(0.999, max(0.02, 1.2 * (1 - new_fine[-1]), b)))
        fine, bad, share = new_fine, new_bad, min(0.99, max(0.01, (sum(p) + 9) / (len(p) + 10)))
    return posterior


def brute_votes(text, m):
    """Votes that can be told from the base measures and simple patterns alone."""
    n, words = m[0], WORD.findall(text or "")
    if not n:
        return [0] * len(RULES)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    ascii_letters = re.findall(r"[A-Za-z]", text)
    upper = sum(c.isupper() for c in ascii_letters) / max(1, len(ascii_letters))
    lettered = sum(bool(re.search(r"[A-Za-z\u0080-\U0010ffff]", w)) for w in words) / n
    doubled = sum(bool(re.search(r"([!-\-/:-@\[-`{-~])\1$", w)) for w in words) / n
    ended = sum(WORD.findall(x)[-1][-1] in ".!?:;\"')]}" for x in lines) / len(lines)
    from vigilar.llm.quality_rules import COMMON

    common = sum(w in COMMON for w in words) / n
    pick = lambda fine, bad: 1 if fine else -1 if bad else 0
    return [
        pick(3 <= m[1] / n <= 10, m[1] / n < 2.5 or m[1] / n > 12), pick(m[2] / n <= 0.02, m[2] / n > 0.1), pick(lettered >= 0.9, lettered < 0.8),
        pick(len(lines) >= 2 and not m[3], m[3] / len(lines) > 0.3), pick(m[4] / n <= 0.03, m[4] / n > 0.12),
        pick(ascii_letters and upper <= 0.2, upper > 0.5), pick(doubled <= 0.02, doubled > 0.1), pick(ended >= 0.6, len(lines) >= 5 and ended < 0.1),
        pick(common >= 0.1, False),
    ]


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    measured = [brute_measures(t) for _, t in rows]
    cast = [brute_votes(t, m) for (_, t), m in zip(rows, measured, strict=True)]
    posterior = brute_em([v for v, m in zip(cast, measured, strict=True) if not brute_failed(m)])
    want = Counter()
    for (i, _), m, v in zip(rows, measured, cast, strict=True):
        p = posterior(v)
        want[(i, *m, brute_failed(m), round(p, 6), not brute_failed(m) and p >= 0.5)] += 1
    got = rule_report(docs).withColumn("p_fine", F.round("p_fine", 6)).select("doc_id", *MEASURES, "base_failed", "p_fine", "kept").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_documents(spark, size):
    check(table(spark, f"/root/testdata/{size}", "documents"))


def test_special_cases(spark):
    check(special_documents(spark))
    assert rule_report(empty_documents(spark)).collect() == []


def test_very_long_text(spark):
    text = "\n".join(sentence(i, 50) + "." for i in range(8000))
    docs = spark.createDataFrame([(1, text), (2, (sentence(1, 40) + "\n") * 10_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in rule_report(docs).collect()}
    assert rows[1]["n_words"] == 400_000 and rows[1]["kept"]
    assert rows[2]["n_dup_lines"] == 9_999 and rows[2]["n_repeat_words"] == 400_000 and rows[2]["base_failed"]


def test_labelled_junk_goes_and_the_rest_stays(spark):
    """No label is used by the operator; those of the tables are its test."""
    folder = "/root/testdata/sf0.1"
    judged = weigh_rules(table(spark, folder, "documents")).join(table(spark, folder, "labels"), "doc_id").where("not base_failed")
    kept = {(r["quality"], r["kept"]): r["n"] for r in judged.groupBy("quality", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept[0, False] >= 0.95 * (kept[0, False] + kept.get((0, True), 0))
    assert kept[1, True] >= 0.995 * (kept[1, True] + kept.get((1, False), 0))


def test_accuracies_are_found_again():
    """Votes drawn from known accuracies."""
    rng = np.random.default_rng(12)
    truth = rng.random(20_000) < 0.85
    fine, bad = np.array([0.99, 0.98, 0.995, 0.99, 0.985]), np.array([0.9, 0.7, 0.8, 0.3, 0.6])
    right = rng.random((len(truth), 5)) < np.where(truth[:, None], fine, bad)
    cast = np.where(rng.random(right.shape) < 0.2, 0, np.where(right == truth[:, None], 1, -1))
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    found = fit_rules(patterns, counts.astype(float))
    assert np.abs(found.fine - fine).max() < 0.01 and np.abs(found.bad - bad).max() < 0.04 and abs(found.share - 0.85) < 0.01


def test_one_failed_rule_need_not_reject(spark):
    """All-must-pass would drop the last text; with the votes of all others it stays."""
    docs = [(i, "\n".join(sentence(40 * i + k, 12).capitalize() + "." for k in range(8))) for i in range(60)]
    docs += [(100 + i, " ".join(w + "***" for w in sentence(i, 60).split())) for i in range(8)]
    docs += [(999, "\n".join(sentence(7000 + k, 12) for k in range(6)))]
    rows = {r["doc_id"]: r for r in weigh_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[999]["votes"]["line_ends"] == -1 and not rows[999]["base_failed"]
    assert all(rows[i]["kept"] for i in range(60)) and not any(rows[100 + i]["kept"] for i in range(8))
