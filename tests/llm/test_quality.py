import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import empty_documents, special_documents, table
from vigilar.llm.quality import classify, fit_labellers, fit_scorer, score

BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Labels of half of the documents are hidden from the fit; the scorer is held against them."""
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    shown = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    hidden = labels.join(shown, "doc_id", "leftanti")
    scores = classify(docs, shown).join(hidden, "doc_id").toPandas()
    junk, toxic = scores["quality"] == 0, scores["toxic"] == 1
    assert ((scores["junk_score"] >= 0.5) == junk).mean() > 0.95
    english_insults = toxic & (scores["toxic_score"] >= 0.5)
    assert english_insults.sum() >= 0.6 * toxic.sum()
    clean = ~junk & ~toxic
    assert scores["kept"][clean].mean() > 0.97


def test_reruns_agree(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(classify(docs, labels)) == key(classify(docs.repartition(5), labels))


def test_special_cases(spark, sf):
    docs = special_documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (None, 1, 1), (12, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(not r["kept"] for r in rows if r["n_words"] == 0) and any(r["kept"] for r in rows)
    none = labels.limit(0)
    assert len(classify(docs, none).collect()) == docs.count()
    assert classify(empty_documents(spark), labels).collect() == []
    assert classify(empty_documents(spark), none).collect() == []


def test_scorer_is_for_other_tables_too(spark, sf):
    scorer = fit_scorer(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert score(special_documents(spark), scorer).count() == special_documents(spark).count()


def test_labellers_find_accuracies():
    """Votes drawn with known accuracies: EM has to find them, and beat every single labeller."""
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.3
    accuracy, coverage = np.array([0.95, 0.8, 0.7, 0.6]), np.array([0.6, 0.9, 0.9, 0.8])
    right = rng.random((20_000, 4)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((20_000, 4)) < coverage)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, rates, prior = fit_labellers(patterns, counts.astype(float))
    found = rates[1, :, 2] / (rates[1, :, 2] + rates[1, :, 0])
    assert np.abs(found - accuracy).max() < 0.08 and abs(prior - 0.3) < 0.08
    assert ((posterior[index.ravel()] > 0.5) == truth).mean() > 0.86
