import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilar.operators import metrics as M
from vigilar.operators.ordered import plan_buckets, running_totals


def frame(spark, labels, scores):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores, strict=True)], "label int, score double")


def test_threshold_is_the_interpolated_percentile(spark):
    df = frame(spark, [0] * 1001, range(1001))
    assert M.percentile_threshold(df, 0.01).first()[0] == pytest.approx(990.0)
    odd = np.random.default_rng(1).random(777)
    for buckets in (10**6, 50):
        got = M.percentile_threshold(frame(spark, [0] * 777, odd), 0.013, rows_per_bucket=buckets).first()[0]
        assert got == pytest.approx(np.percentile(odd, 98.7), abs=1e-12)


def test_ci(spark):
    row = spark.range(1).select(M.ci_halfwidth(F.lit(0.9), F.lit(100)).alias("a"), M.ci_halfwidth(F.lit(0.9), F.lit(0)).alias("b")).first()
    assert row.a == pytest.approx(1.96 * math.sqrt(0.9 * 0.1 / 100))
    assert row.b == 0.0


def evaluate(spark, labels, scores, threshold):
    df = frame(spark, labels, scores).withColumn("cell", F.lit("x"))
    thr = spark.createDataFrame([("x", threshold)], "cell string, threshold double")
    return M.evaluate(df, thr, ["cell"]).first()


def test_perfect_separation(spark):
    r = evaluate(spark, [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9], 0.5)
    assert [r.f1, r.accuracy, r.precision, r.recall, r.auroc, r.auprc] == [1.0] * 6
    assert r.fpr == 0.0


def test_half_fpr_and_recall(spark):
    r = evaluate(spark, [0, 0, 1, 1], [0.1, 0.9, 0.2, 0.8], 0.5)
    assert (r.fpr, r.recall) == (0.5, 0.5)


def test_score_on_the_threshold_is_not_an_alert(spark):
    r = evaluate(spark, [0, 1], [0.5, 0.5], 0.5)
    assert (r.tp, r.fp) == (0, 0)


def test_one_class_sets_have_null_areas(spark):
    r = evaluate(spark, [0, 0], [0.1, 0.9], 0.5)
    assert r.auroc is None and r.auprc is None and r.recall == 0.0


def test_recall_per_technique_skips_missing_names(spark):
    rows = [(1, 1, "tautology"), (1, 0, "tautology"), (1, 1, "union"), (1, 1, None), (1, 1, "")]
    got = M.recall_per_technique(spark.createDataFrame(rows, "label int, pred int, attack_technique string")).collect()
    assert {r.attack_technique: r.recall for r in got} == {"tautology": 0.5, "union": 1.0}


def test_auroc_is_the_pairwise_definition_for_any_bucketing(spark):
    rng = np.random.default_rng(3)
    labels = (rng.random(600) < 0.3).astype(int)
    scores = np.round(rng.random(600) + 0.2 * labels, 2)
    pos, neg = scores[labels == 1], scores[labels == 0]
    want = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    for df in (frame(spark, labels, scores), frame(spark, labels, scores).repartition(7), frame(spark, labels, scores).coalesce(1)):
        for per in (10**6, 40):
            assert M.curve_areas(df, rows_per_bucket=per).first().auroc == pytest.approx(want, abs=1e-12)


def test_running_totals_of_a_hot_key(spark):
    """One key holds most rows: it is cut into buckets, the others are not; totals stay exact."""
    rows = [("hot", float(i % 500), 1) for i in range(3000)] + [("cold", float(i), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    buckets = plan_buckets(df, ["k"], "v", 200)
    assert [r.k for r in buckets.bounds.collect()] == ["hot"]
    cut = running_totals(df, ["k"], "v", {"n": F.col("n")}, buckets=buckets)
    whole = running_totals(df, ["k"], "v", {"n": F.col("n")})
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert cut.where("k = 'hot'").agg(F.max("cum_n")).first()[0] == 3000


def test_insider_rows_get_the_lowest_score(spark):
    rows = [("insider", 0.9), ("union", 0.4), (None, 0.1)]
    df = spark.createDataFrame(rows, "attack_technique string, score double")
    assert sorted(r.score for r in M.mask_insider(df).collect()) == [0.1, 0.1, 0.4]
    assert sorted(r.score for r in M.mask_insider(df, observes_insider=True).collect()) == [0.1, 0.4, 0.9]


def test_metric_key(spark):
    assert spark.range(1).select(M.metric_key(F.lit("time (blind)!"))).first()[0] == "recall_time _blind_"


def test_thinning_matches_even_spacing(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    kept = sorted(int(r.x) for r in M.thin_curve(df, [], "x", 50).collect())
    assert kept == sorted(set(np.linspace(0, 999, 50).astype(int).tolist()))
