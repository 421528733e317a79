"""Calibration and detection metrics over score tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from vigilar.operators import metrics as M
from vigilar.session import scratch_dir
from vigilar.sources import sinks
from vigilar.sources.tables import corpus
from vigilar.workload.common import CORPUS, DOC_SCORES, SCORES, big, doc_scores, query, r6, rounded, scores

# Distinct scores of a cell from the top down with running positives and negatives.
STEPS = f"""{SCORES}, by_score AS (
  SELECT cell, score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM scores GROUP BY cell, score),
steps AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY cell) AS pos,
  sum(n) OVER (PARTITION BY cell) AS neg,
  lead(p) OVER (PARTITION BY cell ORDER BY score DESC) AS np, lead(n) OVER (PARTITION BY cell ORDER BY score DESC) AS nn,
  row_number() OVER (PARTITION BY cell ORDER BY score DESC) AS pos_no
  FROM by_score WINDOW w AS (PARTITION BY cell ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""

THRESHOLDS = "thr AS (SELECT cell, quantile_cont(score, 0.95) AS threshold FROM scores WHERE label = 0 GROUP BY cell)"


def thresholds(spark, sf):
    return M.percentile_threshold(scores(spark, sf).where(F.col("label") == 0), 0.05, ["cell"])


@query("row_counts", f"WITH {CORPUS} SELECT domain, split, count(*) AS n_rows, sum(label)::BIGINT AS n_attacks FROM corpus GROUP BY domain, split")
def row_counts(spark, sf):
    return big(M.row_counts(corpus(spark, sf), ["domain", "split"]), "n_attacks")


@query("threshold_fpr", f"WITH {SCORES}, {THRESHOLDS} SELECT cell, round(threshold, 6) AS threshold FROM thr")
def threshold_fpr(spark, sf):
    return rounded(thresholds(spark, sf), "threshold")


@query(
    "insider_mask",
    f"""WITH {DOC_SCORES} SELECT row_id, cell,
    CASE WHEN attack_technique = 'insider' THEN min(score) OVER (PARTITION BY cell) ELSE score END AS score FROM doc_scores""",
)
def insider_mask(spark, sf):
    return M.mask_insider(doc_scores(spark, sf), ["cell"]).select("row_id", "cell", "score")


@query(
    "insider_visible_by_extractor",
    f"""WITH {DOC_SCORES}, x AS (SELECT *, cell IN ('a', 'b') AS seen FROM doc_scores)
    SELECT cell, round(sum(CASE WHEN attack_technique = 'insider' AND NOT seen THEN low ELSE score END), 6) AS total
    FROM (SELECT *, min(score) OVER (PARTITION BY cell) AS low FROM x) GROUP BY cell""",
)
def insider_visible_by_extractor(spark, sf):
    masked = M.mask_insider(doc_scores(spark, sf), ["cell"], F.col("cell").isin("a", "b"))
    return masked.groupBy("cell").agg(r6(F.sum("score")).alias("total"))


@query(
    "confusion_metrics",
    f"""WITH {SCORES}, {THRESHOLDS}, c AS (
      SELECT s.cell, count(*) FILTER (label = 0 AND score <= threshold) AS tn, count(*) FILTER (label = 0 AND score > threshold) AS fp,
        count(*) FILTER (label = 1 AND score <= threshold) AS fn, count(*) FILTER (label = 1 AND score > threshold) AS tp
      FROM scores s JOIN thr USING (cell) GROUP BY s.cell)
    SELECT cell, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
      round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr FROM c""",
)
def confusion_metrics(spark, sf):
    pred = M.predict(scores(spark, sf), thresholds(spark, sf), ["cell"])
    return rounded(M.rates(M.confusion(pred, ["cell"])), "precision", "recall", "f1", "accuracy", "fpr")


_AUROC = "sum(n * (tp - p / 2)) / nullif(max(pos) * max(neg), 0)"
_AP = "sum(p * tp / (tp + fp)) / nullif(max(pos), 0)"
_AUPRC = """sum(p * (tp / (tp + fp) + CASE WHEN tp + fp - p - n = 0 THEN 1 ELSE (tp - p) / (tp + fp - p - n) END) / 2)
  / nullif(max(pos), 0)"""


@query("auroc", f"WITH {STEPS} SELECT cell, round({_AUROC}, 6) AS auroc FROM steps GROUP BY cell")
def auroc(spark, sf):
    return rounded(M.curve_areas(scores(spark, sf), ["cell"]).select("cell", "auroc"), "auroc")


@query("auprc_trapezoid", f"WITH {STEPS} SELECT cell, round({_AUPRC}, 6) AS auprc FROM steps GROUP BY cell")
def auprc_trapezoid(spark, sf):
    return rounded(M.curve_areas(scores(spark, sf), ["cell"]).select("cell", "auprc"), "auprc")


@query("average_precision", f"WITH {STEPS} SELECT cell, round({_AP}, 6) AS average_precision FROM steps GROUP BY cell")
def average_precision(spark, sf):
    return rounded(M.curve_areas(scores(spark, sf), ["cell"]).select("cell", "average_precision"), "average_precision")


@query(
    "auroc_bucketed",
    f"WITH {STEPS.replace('user_id % 8', '0')} SELECT round({_AUROC}, 6) AS auroc, round({_AUPRC}, 6) AS auprc FROM steps",
)
def auroc_bucketed(spark, sf):
    """One key with every row: the table is cut into many value buckets, as it would be at scale."""
    areas = M.curve_areas(scores(spark, sf), rows_per_bucket=500)
    return rounded(areas.select("auroc", "auprc"), "auroc", "auprc")


@query(
    "evaluate_cells",
    f"""WITH {STEPS}, {THRESHOLDS}, m AS (SELECT cell, max(threshold) AS threshold, {_AUROC} AS auroc, {_AUPRC} AS auprc,
      {_AP} AS average_precision, max(pos)::BIGINT AS n_attacks, (max(pos) + max(neg))::BIGINT AS n_test,
      coalesce(sum(p) FILTER (score > threshold), 0) AS tp, coalesce(sum(n) FILTER (score > threshold), 0) AS fp,
      max(pos) AS pos, max(neg) AS neg FROM steps JOIN thr USING (cell) GROUP BY cell)
    SELECT cell, n_attacks, n_test, round(threshold, 6) AS threshold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc,
      round(average_precision, 6) AS average_precision, round(coalesce(2 * tp / nullif(tp + fp + pos, 0), 0), 6) AS f1,
      round(1.96 * sqrt(auroc * (1 - auroc) / n_test), 6) AS auroc_ci FROM m""",
)
def evaluate_cells(spark, sf):
    """All metrics of all cells from one pass over the score steps."""
    out = M.evaluate(scores(spark, sf), thresholds(spark, sf), ["cell"])
    cols = ["threshold", "auroc", "auprc", "average_precision", "f1", "auroc_ci"]
    return rounded(out.select("cell", "n_attacks", "n_test", *cols), *cols)


@query(
    "roc_points",
    f"""WITH {STEPS} SELECT cell, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, score AS threshold FROM steps
      WHERE pos_no = 1 OR np IS NULL OR np <> p OR nn <> n
    UNION ALL SELECT DISTINCT cell, 0.0, 0.0, 'infinity'::DOUBLE FROM scores""",
)
def roc_points(spark, sf):
    return rounded(M.roc_points(scores(spark, sf), ["cell"]), "fpr", "tpr")


@query(
    "pr_points",
    f"""WITH {STEPS} SELECT cell, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, score AS threshold FROM steps
    UNION ALL SELECT DISTINCT cell, 1.0, 0.0, NULL::DOUBLE FROM scores""",
)
def pr_points(spark, sf):
    return rounded(M.pr_points(scores(spark, sf), ["cell"]), "precision", "recall")


@query(
    "curve_store",
    f"WITH {STEPS} SELECT cell, count(*) + 1 AS n_points, round(max(tp / pos), 6) AS top FROM steps GROUP BY cell",
)
def curve_store(spark, sf):
    """Curve points written per cell and read back for re-plotting."""
    path = f"{scratch_dir(spark, 'curves')}/roc"
    sinks.write_curve(M.roc_points(scores(spark, sf), ["cell"], drop_collinear=False), path, ["cell"])
    back = spark.read.schema("fpr double, tpr double, threshold double, cell bigint").parquet(path)
    return back.groupBy("cell").agg(F.count(F.lit(1)).alias("n_points"), r6(F.max("tpr")).alias("top"))


@query(
    "curve_downsample",
    f"""WITH {STEPS}, pts AS (SELECT cell, score FROM steps UNION ALL SELECT DISTINCT cell, 'Infinity'::DOUBLE FROM steps),
    ranked AS (SELECT cell, score, row_number() OVER (PARTITION BY cell ORDER BY score) - 1 AS pos0,
      count(*) OVER (PARTITION BY cell) AS cnt FROM pts),
    wanted AS (SELECT DISTINCT cell, floor(i * ((cnt - 1)::DOUBLE / 99.0))::BIGINT AS pos0
      FROM (SELECT DISTINCT cell, cnt FROM ranked), range(0, 100) t(i))
    SELECT r.cell, r.score AS threshold FROM ranked r LEFT JOIN wanted w ON r.cell = w.cell AND r.pos0 = w.pos0
    WHERE cnt <= 100 OR w.pos0 IS NOT NULL OR r.pos0 = cnt - 1""",
)
def curve_downsample(spark, sf):
    points = M.roc_points(scores(spark, sf), ["cell"], drop_collinear=False)
    return M.thin_curve(points, ["cell"], "threshold", 100).select("cell", "threshold")


@query(
    "ci_halfwidth",
    f"""WITH {CORPUS} SELECT domain, round(CASE WHEN count(*) > 0 THEN 1.96 * sqrt(avg(label) * (1 - avg(label)) / count(*)) ELSE 0 END, 6) AS ci
    FROM corpus GROUP BY domain""",
)
def ci_halfwidth(spark, sf):
    rate = corpus(spark, sf).groupBy("domain").agg(F.avg("label").alias("s"), F.count(F.lit(1)).alias("n"))
    return rate.select("domain", r6(M.ci_halfwidth("s", "n")).alias("ci"))


@query(
    "recall_per_attack",
    f"""WITH {DOC_SCORES} SELECT cell, attack_technique, concat('recall_', attack_technique) AS metric,
    round(avg(CASE WHEN score > 2.0 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM doc_scores
    WHERE label = 1 AND attack_technique <> '' GROUP BY cell, attack_technique""",
)
def recall_per_attack(spark, sf):
    pred = M.predict(doc_scores(spark, sf), 2.0)
    out = M.recall_per_technique(pred, ["cell"])
    return rounded(out.withColumn("metric", M.metric_key("attack_technique")), "recall")


@query(
    "metric_keys",
    """SELECT DISTINCT concat('recall_', trim(regexp_replace(url, '[^0-9A-Za-z_\\-./ ]+', '_', 'g'))) AS metric FROM pages""",
)
def metric_keys(spark, sf):
    from vigilar.sources.tables import table

    return table(spark, sf, "pages").select(M.metric_key("url").alias("metric")).distinct()


@query("prevalence", f"WITH {CORPUS} SELECT domain, round(avg(label), 6) AS prevalence FROM corpus GROUP BY domain")
def prevalence(spark, sf):
    return rounded(M.prevalence(corpus(spark, sf), ["domain"]), "prevalence")


@query("prevalence_from_curve", f"WITH {SCORES} SELECT cell, round(avg(label), 6) AS prevalence FROM scores GROUP BY cell")
def prevalence_from_curve(spark, sf):
    return rounded(M.prevalence_from_curve(M.pr_points(scores(spark, sf), ["cell"]), ["cell"]), "prevalence")
