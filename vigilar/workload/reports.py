"""Reports over the run log derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilar.plans import protocols as P
from vigilar.plans import reports as R
from vigilar.sources.scenarios import IN_DOMAIN, LODO
from vigilar.sources.tables import K_BUDGETS, TECHNIQUES, runs, table
from vigilar.workload.common import RUNS, query, r6, rounded, sql_list

CELL = ["extractor", "engine", "scenario"]
_ID, _LODO = sql_list(IN_DOMAIN), sql_list(LODO)


def cells(spark, sf, **names):
    return R.cells(runs(spark, sf), names or {"auroc": "roc_auc", "auprc": "auprc", "auroc_ci": "auroc_ci", "f1": "f1"})


@query("finished_full_runs", f"WITH {RUNS} SELECT run_id, extractor, engine, scenario FROM done")
def finished_full_runs(spark, sf):
    return R.with_cell_tags(R.finished_runs(runs(spark, sf))).select("run_id", *CELL)


@query("legacy_tag_coalesce", f"WITH {RUNS} SELECT run_id, extractor, engine, scenario, setting, target FROM runs")
def legacy_tag_coalesce(spark, sf):
    return R.with_cell_tags(runs(spark, sf)).select("run_id", *CELL, "setting", "target")


@query("metric_numbers", f"WITH {RUNS} SELECT run_id, round(rate, 6) AS auroc FROM runs")
def metric_numbers(spark, sf):
    """NaN and unparsable metric values become NULL."""
    return runs(spark, sf).select("run_id", r6(R.metric("roc_auc")).alias("auroc"))


@query("latest_run_per_cell", f"WITH {RUNS} SELECT extractor, engine, scenario, run_id, round(rate, 6) AS auroc FROM cells")
def latest_run_per_cell(spark, sf):
    done = R.with_cell_tags(R.finished_runs(runs(spark, sf)))
    return rounded(R.latest_run(done, CELL, {"run_id": F.col("run_id"), "auroc": R.metric("roc_auc")}), "auroc")


@query(
    "latest_non_null",
    f"""WITH {RUNS}, v AS (SELECT *, row_number() OVER (PARTITION BY extractor, engine, scenario ORDER BY start_time DESC, run_id DESC) AS r
      FROM done WHERE rate IS NOT NULL) SELECT extractor, engine, scenario, round(rate, 6) AS auroc FROM v WHERE r = 1""",
)
def latest_non_null(spark, sf):
    done = R.with_cell_tags(R.finished_runs(runs(spark, sf)))
    return rounded(R.latest_value(done, CELL, R.metric("roc_auc"), "auroc"), "auroc")


@query(
    "two_experiments",
    f"""WITH {RUNS}, v AS (SELECT *, row_number() OVER (PARTITION BY extractor, engine ORDER BY start_time DESC, run_id DESC) AS r
      FROM done WHERE experiment IN ('exp-a', 'exp-b')) SELECT extractor, engine, experiment, run_id FROM v WHERE r = 1""",
)
def two_experiments(spark, sf):
    done = R.with_cell_tags(R.finished_runs(runs(spark, sf), experiments=["exp-a", "exp-b"]))
    return R.latest_run(done, ["extractor", "engine"], {"experiment": F.col("experiment"), "run_id": F.col("run_id")})


@query(
    "newest_across_spellings",
    f"""WITH {RUNS}, v AS (SELECT *, row_number() OVER (PARTITION BY extractor ORDER BY start_time DESC, run_id DESC) AS r
      FROM runs WHERE ((run_id // 8) % 2 = 1 OR run_id % 3 = 0) AND scenario = 'b-b' AND run_type = 'full-run' AND engine = 'ae')
    SELECT extractor, run_id AS run FROM v WHERE r = 1""",
)
def newest_across_spellings(spark, sf):
    return R.newest_of_spellings(runs(spark, sf), "b-b", "ae")


_GRID = "(SELECT DISTINCT extractor FROM runs), (SELECT DISTINCT engine FROM runs), (SELECT DISTINCT scenario FROM runs)"


@query("grid_cells", f"WITH {RUNS} SELECT extractor, engine, scenario FROM {_GRID}")
def grid_cells(spark, sf):
    return R.expected_grid(R.with_cell_tags(runs(spark, sf)), CELL)


# A run log without the runs of some cells, so that there is something to miss.
_THIN = "thin AS (SELECT * FROM cells WHERE NOT (engine = 'lof' AND scenario IN ('a-a', 'bcd-a')))"


@query(
    "missing_cells",
    f"""WITH {RUNS}, {_THIN} SELECT g.extractor, g.engine, g.scenario, CASE WHEN t.run_id IS NULL THEN 'missing' ELSE 'incomplete' END AS problem
    FROM (SELECT * FROM {_GRID}) g LEFT JOIN thin t ON g.extractor = t.extractor AND g.engine = t.engine AND g.scenario = t.scenario
    WHERE t.run_id IS NULL OR t.rate IS NULL""",
)
def missing_cells(spark, sf):
    grid = R.expected_grid(R.with_cell_tags(runs(spark, sf)), CELL)
    have = cells(spark, sf).where(~((F.col("engine") == "lof") & F.col("scenario").isin("a-a", "bcd-a")))
    return R.missing_cells(grid, have, CELL, ["auroc", "auprc"])


@query(
    "outstanding_cells",
    f"""WITH {RUNS}, {_THIN} SELECT g.extractor, g.engine, count(*) AS n_outstanding FROM (SELECT * FROM {_GRID}) g
    WHERE NOT EXISTS (SELECT 1 FROM thin t WHERE g.extractor = t.extractor AND g.engine = t.engine AND g.scenario = t.scenario)
    GROUP BY g.extractor, g.engine""",
)
def outstanding_cells(spark, sf):
    grid = R.expected_grid(R.with_cell_tags(runs(spark, sf)), CELL)
    have = cells(spark, sf).where(~((F.col("engine") == "lof") & F.col("scenario").isin("a-a", "bcd-a")))
    return R.outstanding(grid, have, CELL, ["extractor", "engine"])


@query(
    "finished_cells_all_k",
    f"""WITH {RUNS} SELECT target, engine, extractor FROM runs WHERE status = 'FINISHED' AND k IN (0, 5, 10, 50)
    GROUP BY target, engine, extractor HAVING count(DISTINCT k) = 4""",
)
def finished_cells_all_k(spark, sf):
    return R.finished_cells(runs(spark, sf), K_BUDGETS)


@query("first_seen_order", f"WITH {RUNS} SELECT extractor, min(run_id) AS first_position FROM runs GROUP BY extractor")
def first_seen_order(spark, sf):
    return R.first_seen(R.with_cell_tags(runs(spark, sf)), "extractor", "run_id")


@query(
    "display_order",
    f"""WITH {RUNS} SELECT extractor, coalesce(CASE extractor WHEN 'cv' THEN 0 WHEN 'li' THEN 1 WHEN 'loginov' THEN 2 END, 3)::BIGINT AS rank
    FROM (SELECT DISTINCT extractor FROM runs)""",
)
def display_order(spark, sf):
    return R.display_order(R.with_cell_tags(runs(spark, sf)).select("extractor").distinct(), "extractor", ["cv", "li", "loginov"])


@query(
    "strict_scenario_mean",
    f"""WITH {RUNS} SELECT extractor, engine, CASE WHEN count(rate) = 4 THEN round(avg(rate), 6) END AS auroc FROM cells
    WHERE list_contains({_ID}, scenario) GROUP BY extractor, engine""",
)
def strict_scenario_mean(spark, sf):
    return rounded(R.strict_mean(cells(spark, sf), ["extractor", "engine"], "scenario", IN_DOMAIN, ["auroc"]), "auroc")


@query(
    "lenient_scenario_mean",
    f"""WITH {RUNS} SELECT extractor, engine, CASE WHEN count(*) = 4 THEN round(avg(rate), 6) END AS auroc FROM cells
    WHERE list_contains({_ID}, scenario) GROUP BY extractor, engine""",
)
def lenient_scenario_mean(spark, sf):
    return rounded(R.lenient_mean(cells(spark, sf), ["extractor", "engine"], "scenario", IN_DOMAIN, ["auroc"]), "auroc")


@query(
    "detailed_table",
    f"""WITH {RUNS} SELECT extractor, engine, scenario, round(rate, 6) AS auroc FROM cells WHERE list_contains({_LODO}, scenario)
    UNION ALL SELECT extractor, engine, 'Average', CASE WHEN count(*) = 4 THEN round(avg(rate), 6) END FROM cells
      WHERE list_contains({_LODO}, scenario) GROUP BY extractor, engine""",
)
def detailed_table(spark, sf):
    return rounded(R.detailed_table(cells(spark, sf), LODO, ["auroc"]), "auroc")


@query(
    "id_vs_lodo_gap",
    f"""WITH {RUNS}, m AS (SELECT extractor, engine,
      CASE WHEN count(rate) FILTER (list_contains({_ID}, scenario)) = 4 THEN avg(rate) FILTER (list_contains({_ID}, scenario)) END AS id_auroc,
      CASE WHEN count(rate) FILTER (list_contains({_LODO}, scenario)) = 4 THEN avg(rate) FILTER (list_contains({_LODO}, scenario)) END AS lodo_auroc
      FROM cells GROUP BY extractor, engine)
    SELECT extractor, engine, round(id_auroc, 6) AS id_auroc, round(lodo_auroc, 6) AS lodo_auroc,
      round(lodo_auroc - id_auroc, 6) + 0.0 AS gap_auroc, lodo_auroc - id_auroc > -0.05 AS small_gap_auroc FROM m""",
)
def id_vs_lodo_gap(spark, sf):
    return rounded(R.gap_summary(cells(spark, sf), ["auroc"]), "id_auroc", "lodo_auroc", "gap_auroc")


@query(
    "drift_delta",
    f"""WITH {RUNS}, d AS (SELECT *, row_number() OVER (PARTITION BY extractor, engine, domain ORDER BY start_time DESC, run_id DESC) AS r FROM done)
    SELECT extractor, engine, CASE WHEN count(rate) = 4 THEN round(avg(rate), 6) END AS auroc_s1,
      CASE WHEN count(rate) = 4 THEN round(avg(rate * 0.95), 6) END AS auroc_s2,
      CASE WHEN count(rate) = 4 THEN round(avg(rate * 0.95) - avg(rate), 6) END AS delta FROM d WHERE r = 1 GROUP BY extractor, engine""",
)
def drift_delta(spark, sf):
    names = {"auroc_s1": "auroc_s1", "auroc_s2": "auroc_s2"}
    per_domain = R.cells(runs(spark, sf), names, ["extractor", "engine", "domain"])
    return rounded(R.drift_summary(per_domain), "auroc_s1", "auroc_s2", "delta")


@query(
    "size_delta",
    f"""WITH {RUNS}, v AS (SELECT *, row_number() OVER (PARTITION BY experiment, extractor, scenario ORDER BY start_time DESC, run_id DESC) AS r
      FROM done WHERE engine = 'ae' AND rate IS NOT NULL), m AS (
      SELECT extractor, CASE WHEN list_contains({_ID}, scenario) THEN 'in_domain' ELSE 'lodo' END AS regime,
        CASE WHEN count(*) FILTER (experiment = 'exp-a') = 4 THEN avg(rate) FILTER (experiment = 'exp-a') END AS a,
        CASE WHEN count(*) FILTER (experiment = 'exp-b') = 4 THEN avg(rate) FILTER (experiment = 'exp-b') END AS b
      FROM v WHERE r = 1 GROUP BY ALL)
    SELECT extractor, regime, round(a, 6) AS "full", round(b, 6) AS big, round(b - a, 6) + 0.0 AS delta FROM m""",
)
def size_delta(spark, sf):
    done = R.with_cell_tags(R.finished_runs(runs(spark, sf))).where(F.col("engine") == "ae")
    one = lambda e: R.latest_value(done.where(F.col("experiment") == e), ["extractor", "scenario"], R.metric("roc_auc"), "auroc")
    out = R.size_table(one("exp-a"), one("exp-b"), {"in_domain": IN_DOMAIN, "lodo": LODO})
    return rounded(out, "full", "big", "delta")


_TABLE = """tbl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extractor, engine ORDER BY start_time DESC, run_id DESC) AS r
  FROM done) WHERE r = 1)"""
_TABLE_NAMES = {
    "precision": "precision", "recall": "recall", "f1": "f1", "fpr": "fpr", "auprc": "auprc", "auroc": "roc_auc",
    **{f"recall_{t}": f"recall_{t}" for t in TECHNIQUES},
}


def method_table(spark, sf):
    return R.cells(runs(spark, sf), _TABLE_NAMES, ["extractor", "engine"])


@query(
    "column_best",
    f"""WITH {RUNS}, {_TABLE}, m AS (SELECT extractor, engine, rate * 0.9 AS precision, rate * 0.85 AS f1, rate * rate AS auprc FROM tbl)
    SELECT extractor, engine, round(precision, 6) AS precision, round(f1, 6) AS f1, round(auprc, 6) AS auprc,
      coalesce(precision = max(precision) OVER (), false) AS best_precision, coalesce(f1 = max(f1) OVER (), false) AS best_f1,
      coalesce(auprc = max(auprc) OVER (), false) AS best_auprc FROM m""",
)
def column_best(spark, sf):
    cols = ["precision", "f1", "auprc"]
    return rounded(R.mark_best(method_table(spark, sf).select("extractor", "engine", *cols), cols), *cols)


@query(
    "recall_heatmap",
    f"""WITH {RUNS}, {_TABLE} SELECT extractor, engine, """
    + ", ".join(f"round_even(rate / {i + 1}.0 * 100.0, 0)::INTEGER AS {t}" for i, t in enumerate(TECHNIQUES))
    + " FROM tbl",
)
def recall_heatmap(spark, sf):
    return R.recall_heatmap(method_table(spark, sf))


@query(
    "topk_f1",
    f"""WITH {RUNS}, {_TABLE} SELECT extractor, engine, round(rate * 0.85, 6) AS f1 FROM tbl
    WHERE rate IS NOT NULL AND extractor LIKE 'trace-%' ORDER BY rate * 0.85 DESC, extractor, engine LIMIT 3""",
)
def topk_f1(spark, sf):
    trace = method_table(spark, sf).where(F.col("extractor").startswith("trace-"))
    return rounded(R.top_by(trace, "f1", 3).select("extractor", "engine", "f1"), "f1")


@query(
    "best_vs_baselines",
    f"""WITH {RUNS}, {_TABLE}, top AS (SELECT extractor, engine, rate, 'top' AS block FROM tbl WHERE rate IS NOT NULL AND extractor LIKE 'trace-%'
      ORDER BY rate * 0.85 DESC, extractor, engine LIMIT 3),
    b AS (SELECT * FROM top UNION ALL SELECT extractor, engine, rate, 'baseline' FROM tbl WHERE extractor IN ('li', 'cv', 'sbert'))
    SELECT extractor, engine, block, round(rate * 0.85, 6) AS f1, coalesce(rate = max(rate) OVER (), false) AS best_f1 FROM b""",
)
def best_vs_baselines(spark, sf):
    out = R.best_against_baselines(method_table(spark, sf), ["li", "cv", "sbert"])
    return rounded(out.select("extractor", "engine", "block", "f1", "best_f1"), "f1")


_FEW = """few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extractor, target, k ORDER BY start_time DESC, run_id DESC) AS r
  FROM runs WHERE status = 'FINISHED' AND setting = 'few_shot' AND engine = 'ae' AND rate IS NOT NULL) WHERE r = 1),
curve AS (SELECT extractor, k, avg(rate) AS auroc FROM few GROUP BY extractor, k HAVING count(DISTINCT target) = 4)"""
_REF = f"""ref AS (SELECT extractor, avg(rate) AS reference FROM (SELECT *, row_number() OVER (PARTITION BY extractor, scenario
  ORDER BY start_time DESC, run_id DESC) AS r FROM done WHERE engine = 'ae' AND rate IS NOT NULL)
  WHERE r = 1 AND list_contains({_ID}, scenario) GROUP BY extractor HAVING count(*) = 4)"""


@query("fewshot_curve", f"WITH {RUNS}, {_FEW} SELECT extractor, k, round(auroc, 6) AS auroc FROM curve")
def fewshot_curve(spark, sf):
    return rounded(R.fewshot_curve(runs(spark, sf)), "auroc")


@query(
    "recovery_k",
    f"""WITH {RUNS}, {_FEW}, {_REF} SELECT extractor, round(max(reference), 6) AS reference, min(k) FILTER (auroc >= reference - 0.01) AS recovery_k
    FROM curve LEFT JOIN ref USING (extractor) GROUP BY extractor""",
)
def recovery_k(spark, sf):
    log = runs(spark, sf)
    return rounded(R.recovery(R.fewshot_curve(log), R.indomain_reference(log)), "reference")


@query(
    "seed_merge",
    f"""WITH {RUNS} SELECT k, count(*) AS n_seeds, round(avg(rate), 6) AS auroc, round(avg(rate * rate), 6) AS auprc,
    round(stddev_pop(rate), 6) AS auroc_std, round(stddev_pop(rate * rate), 6) AS auprc_std, round(avg(rate * 0.85), 6) AS f1 FROM runs GROUP BY k""",
)
def seed_merge(spark, sf):
    rows = runs(spark, sf).withColumn("k", R.param("k").cast("int")).withColumn("threshold", F.lit(None).cast("double"))
    rows = rows.withColumns({n: R.metric(n) for n in ("auroc", "auprc", "auroc_ci", "f1", "recall")})
    cols = ["auroc", "auprc", "auroc_std", "auprc_std", "f1"]
    return rounded(P.merge_seeds(rows).select("k", "n_seeds", *cols), *cols)


@query(
    "latency_points",
    f"""WITH {RUNS}, {_TABLE}, meas AS (SELECT engine, extractor, sum(floor(val))::BIGINT AS secs, count(*) AS n FROM done WHERE engine <> 'lof'
      AND extractor <> 'sbert' AND val IS NOT NULL GROUP BY engine, extractor),
    bench AS (SELECT * FROM (SELECT engine, extractor, val / 100.0 AS ms, row_number() OVER (PARTITION BY engine, extractor
      ORDER BY start_time DESC, run_id DESC) AS r FROM runs WHERE status = 'FINISHED' AND val IS NOT NULL) WHERE r = 1)
    SELECT t.engine, t.extractor, round(t.rate, 6) AS auroc, round(coalesce(m.secs::DOUBLE / m.n * 1000.0, b.ms), 6) AS ms
    FROM tbl t LEFT JOIN meas m USING (engine, extractor) LEFT JOIN bench b USING (engine, extractor)
    WHERE t.rate IS NOT NULL AND coalesce(m.secs::DOUBLE / m.n * 1000.0, b.ms) IS NOT NULL""",
)
def latency_points(spark, sf):
    """Totals written as HH:MM:SS text take precedence over benchmarked times."""
    log = R.with_cell_tags(runs(spark, sf))
    done = R.finished_runs(log)
    keys = ["engine", "extractor"]
    val = R.metric("infer_median_seconds")
    total = done.where((F.col("engine") != "lof") & (F.col("extractor") != "sbert") & val.isNotNull())
    total = total.groupBy(*keys).agg(F.sum(F.floor(val)).alias("s"), F.count(F.lit(1)).alias("n"))
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    s = F.col("s").cast("bigint")
    hms = F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))
    measured = total.select(*keys, (R.seconds_of(hms) / F.col("n") * 1000.0).alias("ms"))
    bench = R.latest_value(R.finished_runs(log, None), keys, R.metric("infer_ms_per_query"), "ms")
    aurocs = R.latest_run(done, keys, {"auroc": R.metric("roc_auc")})
    return rounded(R.latency_points(aurocs, measured, bench), "auroc", "ms")


@query(
    "median_latency",
    """WITH t AS (SELECT event_type AS extractor, user_id % 3 AS method, value AS seconds, 1000 + event_id % 7 AS n_test FROM events)
    SELECT method, extractor, round(median(seconds), 6) AS median_seconds, max(n_test) AS n_test, count(*) AS repeats,
      round(median(seconds) / max(n_test) * 1000.0, 6) AS ms_per_query FROM t GROUP BY method, extractor""",
)
def median_latency(spark, sf):
    timings = table(spark, sf, "events").select(
        F.col("event_type").alias("extractor"), (F.col("user_id") % 3).alias("method"), F.col("value").alias("seconds"),
        (F.col("event_id") % 7 + 1000).alias("n_test"),
    )
    return rounded(P.latency(timings), "median_seconds", "ms_per_query")


