"""Threshold calibration and detection metrics over long score tables.

A score table is (cell keys..., label, score[, attack_technique]). All cells are
evaluated by the same job: equal scores are collapsed, running totals come from
``running_totals`` and every metric is one aggregation over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilar.operators.ordered import ROWS_PER_BUCKET, running_totals
from vigilar.session import small_side

CI_Z = 1.96  # fixed value: 95 % two-sided normal quantile


def ci_halfwidth(score, n) -> Column:
    """Normal-approximation half-width of a rate over ``n`` rows; 0 for no rows."""
    s = F.col(score) if isinstance(score, str) else score
    k = F.col(n) if isinstance(n, str) else n
    return F.when(k > 0, F.lit(CI_Z) * F.sqrt(s * (F.lit(1.0) - s) / k)).otherwise(F.lit(0.0))


def row_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and attacks per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_attacks"))


def percentile_threshold(
    df: DataFrame,
    target_fpr: float,
    keys: Sequence[str] = (),
    score: str = "score",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per key the linearly interpolated ``(1 - target_fpr)`` percentile of the benign scores.

    Two exact order statistics are read off the running counts, so no group's scores
    are ever gathered in one place.
    """
    keys = list(keys)
    run = running_totals(df.where(F.col(score).isNotNull()), keys, score, {"n": F.lit(1)}, rows_per_bucket=rows_per_bucket)
    pos = F.lit(1.0 - target_fpr) * (F.col("total_n") - 1).cast("double")
    at = lambda k: F.min(F.when(F.col("cum_n") > k, F.col(score)))
    picked = run.groupBy(*keys).agg(
        at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"), F.max(pos - F.floor(pos)).alias("_t")
    )
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_t")).alias("threshold"))


def mask_insider(
    df: DataFrame, keys: Sequence[str] = (), observes_insider: bool | Column = False, technique: str = "attack_technique"
) -> DataFrame:
    """Set the score of insider attacks to the lowest score of their cell.

    Collectors that see insider traffic (``observes_insider``) keep their scores.
    """
    if observes_insider is True:
        return df
    keys = list(keys)
    seen = F.lit(observes_insider) if isinstance(observes_insider, bool) else observes_insider
    hidden = (F.col(technique) == "insider") & ~seen
    if keys:
        lows = small_side(df.groupBy(*keys).agg(F.min("score").alias("_low")))
        joined = df.join(lows, keys)
        low = F.col("_low")
    else:
        joined = df
        low = F.lit(df.agg(F.min("score")).first()[0])
    return joined.withColumn("score", F.when(hidden, low).otherwise(F.col("score"))).select(*df.columns)


def score_steps(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row per distinct score, from the highest down, with running true/false positives.

    Columns: keys, score, p, n (positives, negatives at this score), cum_*, total_*, next_*.
    """
    measures = {"p": (F.col(label) == 1).cast("long"), "n": (F.col(label) != 1).cast("long")}
    return running_totals(df, list(keys), score, measures, descending=True, rows_per_bucket=rows_per_bucket)


def _areas() -> dict[str, Column]:
    d = lambda c: F.col(c).cast("double")
    tp, fp, p, n = d("cum_p"), d("cum_n"), d("p"), d("n")
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp - p, tp + fp - p - n), F.lit(1.0))
    return {
        "auroc": F.try_divide(F.sum(n * (tp - p / 2.0)), F.max(d("total_p")) * F.max(d("total_n"))),
        "auprc": F.try_divide(F.sum(p * (precision + before) / 2.0), F.max(d("total_p"))),
        "average_precision": F.try_divide(F.sum(p * precision), F.max(d("total_p"))),
    }


def curve_areas(df: DataFrame, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """AUROC, AUPRC (trapezoid) and average precision (step sum) per key; NULL without positives.

    A one-class test set without negatives has no AUROC either.
    """
    return score_steps(df, keys, rows_per_bucket=rows_per_bucket).groupBy(*keys).agg(
        *[c.alias(name) for name, c in _areas().items()]
    )


def confusion(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts tn, fp, fn, tp per key."""
    y, z = F.col(label), F.col(pred)
    return df.groupBy(*keys).agg(
        F.count_if((y == 0) & (z == 0)).alias("tn"),
        F.count_if((y == 0) & (z == 1)).alias("fp"),
        F.count_if((y == 1) & (z == 0)).alias("fn"),
        F.count_if((y == 1) & (z == 1)).alias("tp"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy, fpr from confusion counts; 0 where undefined."""
    d = lambda c: F.col(c).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tn, fp, fn, tp = d("tn"), d("fp"), d("fn"), d("tp")
    return counts.withColumns(
        {
            "precision": zero(F.try_divide(tp, tp + fp)),
            "recall": zero(F.try_divide(tp, tp + fn)),
            "f1": zero(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)),
            "accuracy": zero(F.try_divide(tp + tn, tp + tn + fp + fn)),
            "fpr": zero(F.try_divide(fp, fp + tn)),
        }
    )


def predict(df: DataFrame, thresholds: DataFrame | float, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``pred``: 1 where the score is strictly above the threshold of its cell."""
    if isinstance(thresholds, (int, float)):
        return df.withColumn("pred", (F.col("score") > F.lit(float(thresholds))).cast("int"))
    if not keys:
        return predict(df, float(thresholds.first()["threshold"]))
    joined = df.join(small_side(thresholds), list(keys), "left")
    return joined.withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))


def evaluate(
    df: DataFrame, thresholds: DataFrame, keys: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Every metric of every cell in one aggregation over the score steps.

    ``thresholds`` has the keys and ``threshold``; a NULL threshold leaves the
    threshold-based metrics NULL.
    """
    keys = list(keys)
    steps = score_steps(df, keys, rows_per_bucket=rows_per_bucket).join(small_side(thresholds), keys, "left")
    above = F.col("score") > F.col("threshold")
    out = steps.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        *[c.alias(name) for name, c in _areas().items()],
        F.max("total_p").alias("n_attacks"),
        F.max(F.col("total_p") + F.col("total_n")).alias("n_test"),
        F.coalesce(F.sum(F.when(above, F.col("p"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("fp"),
        F.max("total_n").alias("_neg"),
    )
    out = out.withColumn("fn", F.col("n_attacks") - F.col("tp")).withColumn("tn", F.col("_neg") - F.col("fp")).drop("_neg")
    out = rates(out)
    for name in ("precision", "recall", "f1", "accuracy", "fpr"):
        out = out.withColumn(name, F.when(F.col("threshold").isNotNull(), F.col(name)))
    return out.withColumn("auroc_ci", ci_halfwidth("auroc", "n_test")).withColumn(
        "auprc_ci", ci_halfwidth("auprc", "n_test")
    )


def recall_per_technique(
    df: DataFrame, keys: Sequence[str] = (), technique: str = "attack_technique", pred: str = "pred"
) -> DataFrame:
    """Long recall per attack technique; missing and empty names are skipped."""
    attacks = df.where((F.col("label") == 1) & (F.col(technique) != ""))
    return attacks.groupBy(*keys, technique).agg(F.avg(F.col(pred).cast("double")).alias("recall"))


def metric_key(name) -> Column:
    """``recall_<technique>`` with characters a metric store does not allow replaced."""
    c = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit("recall_"), F.trim(F.regexp_replace(c, r"[^0-9A-Za-z_\-./ ]+", "_")))


def roc_points(
    df: DataFrame, keys: Sequence[str] = (), drop_collinear: bool = True, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, plus the origin with threshold +infinity.

    With ``drop_collinear`` inner points on a straight segment are left out; the curve
    and its area stay the same.
    """
    keys = list(keys)
    steps = score_steps(df, keys, rows_per_bucket=rows_per_bucket)
    if drop_collinear:
        first = (F.col("cum_p") == F.col("p")) & (F.col("cum_n") == F.col("n"))
        turns = (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))
        steps = steps.where(first | F.col("next_p").isNull() | turns)
    tpr = F.try_divide(F.col("cum_p").cast("double"), F.col("total_p").cast("double"))
    fpr = F.try_divide(F.col("cum_n").cast("double"), F.col("total_n").cast("double"))
    points = steps.select(*keys, fpr.alias("fpr"), tpr.alias("tpr"), F.col("score").cast("double").alias("threshold"))
    start = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    origin = start.select(
        *keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(origin)


def pr_points(df: DataFrame, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(precision, recall, threshold) per distinct score, plus (1, 0) without threshold."""
    keys = list(keys)
    steps = score_steps(df, keys, rows_per_bucket=rows_per_bucket)
    tp, fp = F.col("cum_p").cast("double"), F.col("cum_n").cast("double")
    points = steps.select(
        *keys,
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp, F.col("total_p").cast("double")).alias("recall"),
        F.col("score").cast("double").alias("threshold"),
    )
    start = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    end = start.select(
        *keys, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(end)


def thin_curve(
    points: DataFrame, keys: Sequence[str], order: str, max_points: int = 400, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """At most ``max_points`` evenly spaced points per curve, both ends kept.

    Position ``floor(i * (n - 1) / (max_points - 1))`` for i = 0, 1, ...; ``order`` must be
    unique within a curve. A point is kept if one of these positions falls on it.
    """
    keys = list(keys)
    ranks = running_totals(points, keys, order, {"n": F.lit(1)}, rows_per_bucket=rows_per_bucket)
    pos, n = F.col("cum_n") - 1, F.col("total_n")
    step = (n - 1).cast("double") / F.lit(float(max_points - 1))
    i = F.ceil(pos.cast("double") / step)
    near = [F.floor(j.cast("double") * step) == pos for j in (i - 1, i, i + 1)]
    keep = (n <= max_points) | near[0] | near[1] | near[2] | (pos == n - 1)
    return points.join(ranks.where(keep).select(*keys, order), [*keys, order], "left_semi")


def prevalence(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of attacks among the rows."""
    return df.groupBy(*keys).agg(F.avg(F.col("label").cast("double")).alias("prevalence"))


def prevalence_from_curve(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision where recall is largest (every row predicted positive)."""
    best = F.max_by("precision", F.struct(F.col("recall"), -F.coalesce(F.col("threshold"), F.lit(float("inf")))))
    return points.groupBy(*keys).agg(best.alias("prevalence"))
