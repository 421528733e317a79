"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

``score_*`` queries time inference only, with fitted detectors, as the latency harness
does: warm-up, repeats, median. ``ms_per_row`` puts them next to the published
milliseconds per query. Other queries are timed end to end.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

# Registered queries timed end to end, written to a no-op sink.
END_TO_END = (
    "scan_split",
    "stratified_cap",
    "lodo_scenarios",
    "fewshot_prefix_samples",
    "li_features_docs",
    "loginov_features",
    "tfidf_long",
    "vocabulary",
    "role_view_terms",
    "trace_tag_counts",
    "zscore_stats",
    "threshold_fpr",
    "evaluate_cells",
    "roc_points",
    "recall_per_attack",
    "latest_run_per_cell",
    "id_vs_lodo_gap",
    "recovery_k",
    "dataset_fingerprint",
    "lof_scores",
)


def timed(run, repeats: int) -> float:
    run()  # warm-up
    times = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return statistics.median(times)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vigilar.operators.autoencoder import AeConfig, config_for
    from vigilar.plans.protocols import train_detector
    from vigilar.sources.tables import corpus, traces
    from vigilar.workload import QUERIES

    seconds: dict[str, float] = {}
    per_row: dict[str, float] = {}
    fit_seconds: dict[str, float] = {}

    docs = corpus(spark, SF_DIR).repartition(int(CPUS)).persist()
    traced = traces(spark, SF_DIR).withColumn("label", F.lit(0)).repartition(int(CPUS)).persist()
    n = docs.count()
    traced.count()
    few = {e: AeConfig(**{**config_for(e).__dict__, "epochs": 5}) for e in ("li", "tfidf", "trace-expert", "trace-ruleid")}
    scored = (
        ("ae", "li", docs), ("ocsvm", "li", docs), ("ae", "tfidf", docs), ("ocsvm", "tfidf", docs),
        ("ae", "trace-expert", traced), ("ocsvm", "trace-expert", traced), ("ae", "trace-ruleid", traced),
    )
    for method, extractor, rows in scored:
        name = f"score_{extractor.replace('-', '_')}_{method}"
        try:
            start = time.perf_counter()
            train = rows.where((F.col("label") == 0) & (F.pmod("row_id", F.lit(2)) == 0))
            det = train_detector(train, method, extractor, few[extractor] if method == "ae" else None)
            fit_seconds[name] = round(time.perf_counter() - start, 3)
            seconds[name] = timed(lambda det=det, rows=rows: drain(det.score(rows)), REPEATS)
            per_row[name] = round(seconds[name] / n * 1000.0, 5)
        except Exception as err:  # one failing query must not hide the others
            print(f"{name}: {err}", file=sys.stderr)
    docs.unpersist()
    traced.unpersist()
    for name in END_TO_END:
        try:
            seconds[name] = timed(lambda name=name: drain(QUERIES[name](spark, SF_DIR)), 1)
        except Exception as err:
            print(f"{name}: {err}", file=sys.stderr)
    out = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows_scored": n,
        "ms_per_row": per_row,
        "fit_seconds": fit_seconds,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
