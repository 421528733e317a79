"""Evaluation protocols: suite grid, concept drift, few-shot adaptation, and timing."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilar.operators import metrics as M
from vigilar.operators.autoencoder import new_state, reconstruction_error, train_array
from vigilar.operators.blocks import dense_matrix
from vigilar.operators.sampling import fit_val_roles, prefix_samples, sample_fraction
from vigilar.plans.detector import Detector, NoFitRowsError
from vigilar.plans.extractors import EXTRACTORS, build_extractor, observes_insider
from vigilar.session import stable
from vigilar.sources.sinks import write_curve

# Fixed values of the protocols.
TARGET_FPR = 0.001
VAL_FRACTION = 0.1
KS = (0, 5, 10, 50, 100, 500, 1000, 10000)
SEEDS = (0, 1, 2, 3, 4)
FINE_TUNE_SCALE = 0.1
CELL = ("scenario", "method", "extractor")


def grid(methods: Sequence[str], extractors: Sequence[str], scenarios: Sequence[str]) -> list[tuple[str, str, str]]:
    """(scenario, method, extractor) cells, methods outermost and scenarios innermost."""
    return [(s, m, e) for m in methods for e in extractors for s in scenarios]


def add_features(rows: DataFrame, extractors: Sequence[str]) -> DataFrame:
    """Compute the vectors of stateless extractors once, as columns that detectors pick up.

    Done before the rows are spread over scenarios, every row is featurised once for all
    scenarios and heads.
    """
    for name in extractors:
        made = build_extractor(name)
        if not made.stateless:
            raise ValueError(f"{name} learns from the fit rows and cannot be computed up front")
        rows = made.transform(rows, f"features_{name}")
    return rows


def _tagged(df: DataFrame, **labels) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in labels.items()})


class Fitted(NamedTuple):
    """One fitted cell: validation and test scores are plans, not yet run."""

    detector: Detector | None
    val: DataFrame
    test: DataFrame
    n_train: int
    fit_seconds: float | None


def fit_and_score(
    train: DataFrame, tests: DataFrame, method: str, extractor: str, keep: Sequence[str], seed=7, config=None,
    build: Callable[..., Detector] = Detector, slow_fraction: float | None = None, **options,
) -> Fitted:
    """Fit on 90 % of the benign train rows; score the other 10 % and the test rows.

    Only with ``slow_fraction`` are the slow extractors evaluated on that share of the rows.
    Without a benign row to fit on there is no detector and all scores are NULL.
    """
    if slow_fraction is not None and extractor in EXTRACTORS and EXTRACTORS[extractor].slow:
        train, tests = sample_fraction(train, slow_fraction, seed), sample_fraction(tests, slow_fraction, seed)
    benign = fit_val_roles(train.where(F.col("label") == 0), VAL_FRACTION, seed)
    began = time.perf_counter()
    try:
        det = build(method, extractor, config, **options).fit(benign.where(F.col("role") == "fit"))
    except NoFitRowsError:
        unknown = F.lit(None).cast("double").alias("score")
        return Fitted(None, benign.limit(0).select("row_id", unknown), tests.select(*keep, unknown), 0, None)
    spent = round(time.perf_counter() - began, 3)
    return Fitted(det, det.score(benign.where(F.col("role") == "val")), det.score(tests, tuple(keep)), det.n_fit, spent)


# The columns of the result tables.
SUITE_COLUMNS = (
    "dataset scenario kind method extractor n_train n_test n_attacks roc_auc average_precision f1 accuracy precision recall fpr auprc "
    "auroc_ci auprc_ci threshold recall_per_attack fit_seconds score_seconds model_path"
).split()
DRIFT_COLUMNS = (
    "dataset domain method extractor n_train n_test_s1 n_attacks_s1 n_test_s2 n_attacks_s2 auroc_s1 auroc_s2 delta_auroc auprc_s1 auprc_s2 "
    "f1_s1 f1_s2 recall_s1 recall_s2 auroc_s1_ci auroc_s2_ci threshold fit_seconds score_seconds model_path"
).split()
FEWSHOT_COLUMNS = (
    "dataset target method extractor lodo_source k seed n_finetune n_test n_attacks auroc auprc f1 recall auroc_ci threshold "
    "finetune_seconds score_seconds base_model_path"
).split()
_FACTS = "n_train long, fit_seconds double, score_seconds double, model_path string"


def _run_cells(
    cells: Sequence[tuple[dict[str, str], DataFrame, DataFrame]], keep: Sequence[str], mask_keys: Sequence[str], seed, configs: dict | None,
    capture_insider: bool, save_to: str | None, save_methods: Sequence[str], side_by_side: int, **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit and score (names, train rows, test rows); long test and validation scores, and facts per cell.

    A few cells are fitted side by side, as the small jobs of one leave the cluster idle;
    what follows is one job for the whole grid.
    """
    names = list(cells[0][0])

    def run(cell: tuple[dict[str, str], DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, tuple]:
        label, train, tests = cell
        method, extractor = label["method"], label["extractor"]
        fitted = fit_and_score(train, tests, method, extractor, keep, seed, (configs or {}).get(method), **options)
        began = time.perf_counter()
        test = stable(fitted.test)
        spent = round(time.perf_counter() - began, 3)
        test = M.mask_insider(test, mask_keys, capture_insider or observes_insider(extractor))
        path = ""
        if save_to is not None and method in save_methods and fitted.detector is not None:
            path = f"{save_to}/{'_'.join(label.values())}"
            fitted.detector.save(path, train.sparkSession)
        return _tagged(test, **label), _tagged(fitted.val, **label), (*label.values(), fitted.n_train, fitted.fit_seconds, spent, path)

    with ThreadPoolExecutor(side_by_side) as pool:
        parts = list(pool.map(run, cells))
    union = lambda i: stable(reduce(DataFrame.unionByName, [p[i] for p in parts]))
    facts = cells[0][1].sparkSession.createDataFrame([p[2] for p in parts], ", ".join(f"{n} string" for n in names) + ", " + _FACTS)
    return union(0), union(1), facts


def suite_scores(
    scenarios: DataFrame, cells: Sequence[tuple[str, str, str]], seed=7, configs: dict | None = None, capture_insider: bool = False,
    save_to: str | None = None, save_methods: Sequence[str] = ("ae",), side_by_side: int = 4, **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test scores, validation scores and facts of all cells: keys of :data:`CELL`.

    ``scenarios`` has (scenario, split, row_id, full_query, label, attack_technique, ...).
    ``capture_insider`` says that the collector of the rows sees insider traffic, whatever the extractor.
    """
    parts = []
    for scenario, method, extractor in cells:
        rows = scenarios.where(F.col("scenario") == scenario)
        label = {"scenario": scenario, "method": method, "extractor": extractor}
        parts.append((label, rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")))
    keep = ("row_id", "label", "attack_technique")
    return _run_cells(parts, keep, [], seed, configs, capture_insider, save_to, save_methods, side_by_side, **options)


def _per_cell(test_scores: DataFrame, val_scores: DataFrame, keys: Sequence[str], part: Sequence[str], target_fpr: float) -> DataFrame:
    """Threshold of every cell, and all metrics with recall per technique of every part of its test rows.

    Parts without a score (nothing to fit on) keep their counts and have NULL metrics.
    """
    keys, per_part = list(keys), [*keys, *part]
    thresholds = stable(M.percentile_threshold(val_scores, target_fpr, keys))
    scored = test_scores.where(F.col("score").isNotNull())
    counts = test_scores.groupBy(*per_part).agg(F.count(F.lit(1)).alias("n_test"), F.sum("label").cast("long").alias("n_attacks"))
    per_set = counts.select(*per_part).join(thresholds, keys, "left")
    metrics = M.evaluate(scored, per_set, per_part).drop("n_test", "n_attacks")
    recalls = M.recall_per_technique(M.predict(scored, thresholds, keys), per_part)
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("attack_technique", "recall"))))
    as_json = recalls.groupBy(*per_part).agg(F.to_json(pairs).alias("recall_per_attack"))
    return counts.join(metrics, per_part, "left").join(as_json, per_part, "left")


def suite_results(
    test_scores: DataFrame, val_scores: DataFrame, facts: DataFrame, dataset: str = "", target_fpr: float = TARGET_FPR, manifest: DataFrame | None = None,
) -> DataFrame:
    """One row of :data:`SUITE_COLUMNS` per cell.

    ``kind`` comes from the manifest entry of the scenario's file where a manifest
    (``manifest_entries``) is given, else from the scenario's name.
    """
    out = _per_cell(test_scores, val_scores, CELL, (), target_fpr).join(F.broadcast(facts), list(CELL))  # a row per cell of the grid
    trained, tested = F.split_part("scenario", F.lit("-"), F.lit(1)), F.split_part("scenario", F.lit("-"), F.lit(-1))
    kind = F.when(trained == tested, "in_domain").otherwise("lodo")
    if manifest is not None:
        entries = manifest.select(F.col("file").alias("_file"), F.col("kind").alias("_kind"))
        out = out.join(F.broadcast(entries), F.concat("scenario", F.lit(".csv")) == F.col("_file"), "left")  # a row per file
        kind = F.coalesce("_kind", kind)
    named = out.withColumn("kind", kind).withColumn("dataset", F.lit(dataset)).withColumnRenamed("auroc", "roc_auc")
    return named.withColumn("recall_per_attack", F.coalesce("recall_per_attack", F.lit("{}"))).select(*SUITE_COLUMNS)


def write_curves(test_scores: DataFrame, folder: str, keys: Sequence[str] = CELL) -> None:
    """ROC and precision-recall points of every cell below ``folder``; a rerun replaces its own cells."""
    scored = test_scores.where(F.col("score").isNotNull())
    write_curve(M.roc_points(scored, keys), f"{folder}/roc", keys)
    write_curve(M.pr_points(scored, keys), f"{folder}/pr", keys)


DRIFT_CELL = ("domain", "method", "extractor")


def drift_scores(
    parts: DataFrame, cells: Sequence[tuple[str, str]], domains: Sequence[str], seed=7, configs: dict | None = None, capture_insider: bool = False,
    save_to: str | None = None, save_methods: Sequence[str] = ("ae",), side_by_side: int = 4, **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit once per (domain, method, extractor) on the origin rows; score origin and shifted test rows.

    ``parts`` comes from ``drift_partitions``; the test scores keep ``part``.
    """
    todo = []
    for domain in domains:
        rows = parts.where(F.col("domain") == domain)
        for method, extractor in cells:
            label = {"domain": domain, "method": method, "extractor": extractor}
            todo.append((label, rows.where(F.col("part") == "origin_train"), rows.where(F.col("part") != "origin_train")))
    keep = ("row_id", "label", "attack_technique", "part")
    return _run_cells(todo, keep, ["part"], seed, configs, capture_insider, save_to, save_methods, side_by_side, **options)


def drift_results(test_scores: DataFrame, val_scores: DataFrame, facts: DataFrame, dataset: str = "", target_fpr: float = TARGET_FPR) -> DataFrame:
    """One row of :data:`DRIFT_COLUMNS` per cell, and the recall per technique of both test sets.

    Both are judged by the one threshold of the cell. Delta is origin minus shifted. Curves of both sets:
    ``write_curves(test_scores, folder, [*DRIFT_CELL, "part"])``.
    """
    wide = pivot_drift(_per_cell(test_scores, val_scores, DRIFT_CELL, ["part"], target_fpr), DRIFT_CELL)
    out = wide.join(F.broadcast(facts), list(DRIFT_CELL)).withColumn("dataset", F.lit(dataset))  # a row per cell of the grid
    return out.select(*DRIFT_COLUMNS, *[F.coalesce(c, F.lit("{}")).alias(c) for c in ("recall_per_attack_s1", "recall_per_attack_s2")])


def pivot_drift(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long metrics per test set to one row per cell with _s1 / _s2 columns and the AUROC drop."""
    wide = {}
    for suffix, part in (("s1", "origin_test"), ("s2", "shifted_test")):
        for name in ("n_test", "n_attacks", "auroc", "auprc", "f1", "recall", "recall_per_attack"):
            wide[f"{name}_{suffix}"] = F.max(F.when(F.col("part") == part, F.col(name)))
        wide[f"auroc_{suffix}_ci"] = F.max(F.when(F.col("part") == part, F.col("auroc_ci")))
    out = metrics.groupBy(*keys).agg(F.max("threshold").alias("threshold"), *[c.alias(n) for n, c in wide.items()])
    return out.withColumn("delta_auroc", F.col("auroc_s1") - F.col("auroc_s2"))


SCORE_BLOCK = 8192


def fewshot_results(
    base: Detector, train: DataFrame, test: DataFrame, ks: Sequence[int] = KS, seeds: Sequence[int] = SEEDS,
    lr_scale: float = FINE_TUNE_SCALE, target_fpr: float = TARGET_FPR, epochs: int | None = None, capture_insider: bool = False,
    target: str = "", source: str = "", dataset: str = "", base_path: str = "",
) -> DataFrame:
    """Adapt a pretrained autoencoder on k benign target rows, for every k and seed: rows of :data:`FEWSHOT_COLUMNS`.

    The largest sample of every seed is featurised once; smaller budgets are its
    prefixes. The adaptations run side by side, one small group of at most ``max(ks)``
    rows each. Their weights stay a table on shared storage: to score, each is joined to every block
    of test features by (k, seed), so a task holds one set of weights and one block, and none
    comes to the driver. k = 0 is the unadapted model and has no threshold.
    """
    if base.method != "ae":
        raise ValueError("few-shot adaptation needs an autoencoder")
    spark = train.sparkSession
    config, dim, weights = base.head.config, base.head.dim, base.head.weights
    lr, run_epochs = config.learning_rate * lr_scale, config.epochs if epochs is None else epochs
    tuned_config = type(config)(**{**base.head.params(), "epochs": run_epochs})
    shared = spark.sparkContext.broadcast(weights)  # the base model, bounded as every autoencoder is
    benign = train.where(F.col("label") == 0)
    budgets = sorted({k for k in ks if k > 0})
    samples = prefix_samples(benign, budgets, seeds)
    largest = base.features(samples.where(F.col("k") == max(budgets, default=0))).select("seed", "place", "features")
    fits = F.filter(F.array(*[F.lit(k) for k in budgets]).cast("array<int>"), lambda k: k >= F.col("place"))
    per_budget = stable(largest).withColumn("k", F.explode(fits))

    def adapt(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        pdf = pdf.sort_values("place")
        x = dense_matrix(pdf["features"], dim, np.float32)
        state = train_array(new_state([w.copy() for w in shared.value]), x, tuned_config, lr)
        spent = round(time.perf_counter() - began, 3)
        own = reconstruction_error(state["w"], x, config.output)
        flat = np.concatenate([w.ravel() for w in state["w"]]).astype(np.float32)
        return pd.DataFrame(
            {"k": [int(pdf["k"].iloc[0])], "seed": [int(pdf["seed"].iloc[0])], "n_finetune": [len(x)], "finetune_seconds": [spent],
             "threshold": [float(np.percentile(own, (1 - target_fpr) * 100))], "weights": [flat.tobytes()]}
        )

    columns = "k int, seed int, n_finetune long, finetune_seconds double, threshold double, weights binary"
    tuned = per_budget.groupBy("k", "seed").applyInPandas(adapt, columns)
    if 0 in ks:
        flat0 = np.concatenate([w.ravel() for w in weights]).astype(np.float32).tobytes()
        tuned = tuned.unionByName(spark.createDataFrame([(0, seeds[0], 0, 0.0, None, flat0)], columns))
    tuned = stable(tuned)
    shapes, output = [w.shape for w in weights], config.output

    def unpack(data: bytes) -> list[np.ndarray]:
        flat, out, at = np.frombuffer(data, dtype=np.float32), [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return out

    def score_block(key, sets: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        net, x = unpack(sets["weights"].iloc[0]), dense_matrix(rows["features"], dim, np.float32)
        out = rows[["row_id", "label", "attack_technique"]].assign(k=np.int32(key[0]), seed=np.int32(key[1]), score=reconstruction_error(net, x, output))
        return out.assign(seconds=(time.perf_counter() - began) / max(1, len(out)))

    feats = stable(base.features(test).select("row_id", "label", "attack_technique", "features"))
    n_blocks = max(1, -(-feats.count() // SCORE_BLOCK))
    variants = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("seed")) for k in ks for s in (seeds if k else seeds[:1])])
    rows = feats.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(n_blocks))).withColumn("v", F.explode(variants)).select("*", "v.*").drop("v")
    sets = tuned.select("k", "seed", "weights", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    by = ["k", "seed", "block"]
    scored = sets.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(
        lambda key, s, r: score_block(key, s, r) if len(s) else pd.DataFrame(columns=["row_id", "label", "attack_technique", "k", "seed", "score", "seconds"]),
        "row_id long, label int, attack_technique string, k int, seed int, score double, seconds double",
    )
    scores = stable(scored)
    masked = M.mask_insider(scores, ["k", "seed"], capture_insider or observes_insider(base.extractor_name))
    facts = tuned.drop("weights").join(scores.groupBy("k", "seed").agg(F.round(F.sum("seconds"), 3).alias("score_seconds")), ["k", "seed"], "left")
    found = M.evaluate(masked, facts.select("k", "seed", "threshold"), ["k", "seed"]).drop("auprc").withColumnRenamed("average_precision", "auprc")
    names = {"dataset": dataset, "target": target, "method": "ae", "extractor": base.extractor_name, "lodo_source": source, "base_model_path": base_path}
    return _tagged(found.join(facts.drop("threshold"), ["k", "seed"]), **names).select(*FEWSHOT_COLUMNS)


def merge_seeds(rows: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """Mean over the seeds of a budget, with the population deviation of the two areas."""
    means = ("auroc", "auprc", "auroc_ci", "f1", "recall", "threshold")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        *[F.avg(m).alias(m) for m in means],
        F.stddev_pop("auroc").alias("auroc_std"),
        F.stddev_pop("auprc").alias("auprc_std"),
    )


# ---- simple fit / evaluate and timing ---------------------------------------------


def train_detector(rows: DataFrame, method: str, extractor: str, config=None, **options) -> Detector:
    """Fit on the benign rows of one table."""
    return Detector(method, extractor, config, **options).fit(rows.where(F.col("label") == 0))


def evaluate_detector(det: Detector, rows: DataFrame) -> DataFrame:
    """roc_auc, average_precision, n_samples and n_attacks of one labelled table."""
    scores = stable(det.score(rows, ("row_id", "label")))  # several metrics read them
    scores = scores.withColumn("cell", F.lit(0))
    none = rows.sparkSession.createDataFrame([(0, None)], "cell int, threshold double")
    return M.evaluate(scores, none, ["cell"]).select(
        F.col("auroc").alias("roc_auc"), "average_precision", F.col("n_test").alias("n_samples"), "n_attacks"
    )


def time_scoring(det: Detector, rows: DataFrame, repeats: int = 5, warmup: int = 1) -> DataFrame:
    """Timings table (repeat, seconds, n_test) of scoring ``rows``; features are not reused."""
    spark = rows.sparkSession
    store, det.store = det.store, None
    try:
        n = rows.count()
        out = []
        for i in range(-warmup, repeats):
            start = time.perf_counter()
            det.score(rows).write.format("noop").mode("overwrite").save()
            if i >= 0:
                out.append((det.method, det.extractor_name, i, time.perf_counter() - start, n))
        return spark.createDataFrame(out, "method string, extractor string, repeat int, seconds double, n_test long")
    finally:
        det.store = store


def latency(timings: DataFrame, keys: Sequence[str] = ("method", "extractor")) -> DataFrame:
    """Median seconds and milliseconds per row of a timings table (no group is sorted in one task)."""
    keys = list(keys)
    middle = M.percentile_threshold(timings.withColumn("score", F.col("seconds")), 0.5, keys)
    facts = timings.groupBy(*keys).agg(F.max("n_test").alias("n_test"), F.count(F.lit(1)).alias("repeats"))
    out = middle.select(*keys, F.col("threshold").alias("median_seconds")).join(facts, keys)
    return out.withColumn("ms_per_query", F.col("median_seconds") / F.col("n_test") * 1000.0)
