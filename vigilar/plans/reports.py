"""Comparison reports over a run log.

A run log is (run_id, experiment, status, start_time, tags MAP, params MAP, metrics MAP)
with metrics as numbers or text. Every report starts from :func:`cells` or
:func:`latest_value`, which read the log once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilar.sources.scenarios import DOMAINS, IN_DOMAIN, LODO

# Fixed values of the reports.
RECOVERY_MARGIN = 0.01
SMALL_GAP = -0.05
TECHNIQUES = ("union", "boolean", "stacked", "error", "time", "inline", "insider")
TABLE_METRICS = ("precision", "recall", "f1", "fpr", "auprc", "auroc")
BEST_METRICS = ("precision", "recall", "f1", "auprc", "auroc")


def number(c) -> Column:
    """A number, or NULL for missing, unparsable and NaN."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def tag(*names: str) -> Column:
    """First of several tag spellings that is present (current name first, legacy after)."""
    return F.coalesce(*[F.element_at(F.col("tags"), n) for n in names])


def metric(name: str) -> Column:
    return number(F.element_at(F.col("metrics"), name))


def param(name: str) -> Column:
    return F.element_at(F.col("params"), name)


def finished_runs(runs: DataFrame, run_type: str | None = "full-run", experiments: Sequence[str] | None = None) -> DataFrame:
    """FINISHED runs of the given experiments; ``run_type=None`` for logs that do not tag it."""
    out = runs.where(F.col("status") == "FINISHED")
    if experiments is not None:
        out = out.where(F.col("experiment").isin(*experiments))
    return out if run_type is None else out.where(F.element_at("tags", "run_type") == run_type)


def with_cell_tags(runs: DataFrame) -> DataFrame:
    """Reconcile current and legacy tag spellings into extractor, engine, scenario, setting.

    Runs without a scenario tag may have it among their parameters.
    """
    return runs.withColumns(
        {
            "extractor": tag("feature_extractor"),
            "engine": tag("decision_engine", "pipeline"),
            "scenario": F.coalesce(tag("scenario", "dataset"), param("scenario")),
            "setting": tag("setting", "kind"),
            "target": tag("target"),
            "domain": tag("domain"),
        }
    )


def latest_run(runs: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Per key the values of its newest run, missing ones included.

    ``max_by`` combines before the shuffle, so a key with very many runs stays cheap.
    """
    rows = runs.dropna(subset=list(keys))
    picked = F.max_by(F.struct(*[c.alias(n) for n, c in values.items()]), F.struct("start_time", "run_id"))
    return rows.groupBy(*keys).agg(picked.alias("_v")).select(*keys, "_v.*")


def latest_value(runs: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Per key the newest value that is not missing."""
    rows = runs.withColumn(name, value).dropna(subset=[*keys, name])
    return rows.groupBy(*keys).agg(F.max_by(name, F.struct("start_time", "run_id")).alias(name))


def cells(runs: DataFrame, names: dict[str, str], keys: Sequence[str] = ("extractor", "engine", "scenario"), **kw) -> DataFrame:
    """Newest finished full run per cell; ``names`` maps output columns to metric names."""
    return latest_run(with_cell_tags(finished_runs(runs, **kw)), keys, {n: metric(m) for n, m in names.items()})


# ---- grid bookkeeping ---------------------------------------------------------------


def expected_grid(cells_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All combinations of the key values that occur (values of a grid dimension are few)."""
    sets = cells_.agg(*[F.collect_set(k).alias(k) for k in keys])
    for k in keys:
        sets = sets.withColumn(k, F.explode(k))
    return sets.select(*keys)


def unmatched_latencies(latencies: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with a latency but no score, which latency plots have to leave out."""
    return latencies.join(scores.select(*keys), list(keys), "left_anti").select(*keys)


def name_problems(asked: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """(name, problem): names asked for that are unknown, or asked for more than once."""
    counted = asked.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    marked = counted.join(F.broadcast(known.select(name, F.lit(True).alias("_known"))), name, "left")
    problem = F.when(F.col("_known").isNull(), "unknown").when(F.col("_n") > 1, "duplicate")
    return marked.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(name, "problem")


def missing_cells(grid: DataFrame, present: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Grid cells that are absent (``missing``) or lack a required value (``incomplete``)."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    marked = grid.join(present.select(*keys, *required, F.lit(True).alias("_there")), list(keys), "left")
    problem = F.when(F.col("_there").isNull(), "missing").when(bad, "incomplete")
    return marked.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*keys, "problem")


def finished_cells(runs: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("target", "engine", "extractor")) -> DataFrame:
    """Few-shot cells that have a finished run for every budget k."""
    rows = with_cell_tags(finished_runs(runs, run_type=None)).dropna(subset=list(keys))
    k = param("k").try_cast("int")
    seen = rows.where(k.isin(*ks)).groupBy(*keys).agg(F.count_distinct(k).alias("n_k"))
    return seen.where(F.col("n_k") == len(set(ks))).select(*keys)


def outstanding(grid: DataFrame, done: DataFrame, keys: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """Cells still to run, per unit; units with nothing left drop out."""
    left = grid.join(done, list(keys), "left_anti")
    return left.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_outstanding"))


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in the order of their first occurrence: (value, first_position)."""
    return df.groupBy(value).agg(F.min(position).alias("first_position")).orderBy("first_position", value)


def display_order(df: DataFrame, name: str, known: Sequence[str]) -> DataFrame:
    """Add ``rank``: known names by their place, unknown ones after them alphabetically."""
    at = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(name))
    return df.withColumn("rank", F.when(at > 0, at - 1).otherwise(F.lit(len(known)))).orderBy("rank", name)


# ---- averages -----------------------------------------------------------------------


def strict_mean(df: DataFrame, keys: Sequence[str], over: str, members: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over a fixed list of members; NULL unless every one of them has the value."""
    rows = df.where(F.col(over).isin(*members))
    return rows.groupBy(*keys).agg(
        *[F.when(F.count(v) == len(members), F.avg(v)).alias(v) for v in values]
    )


def lenient_mean(df: DataFrame, keys: Sequence[str], over: str, members: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of the values present; NULL unless every member has a row."""
    rows = df.where(F.col(over).isin(*members))
    return rows.groupBy(*keys).agg(
        *[F.when(F.count(F.lit(1)) == len(members), F.avg(v)).alias(v) for v in values]
    )


def detailed_table(cells_: DataFrame, scenarios: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows per scenario plus an ``Average`` row per (extractor, engine)."""
    keys = ["extractor", "engine"]
    rows = cells_.where(F.col("scenario").isin(*scenarios)).select(*keys, "scenario", *values)
    average = lenient_mean(cells_, keys, "scenario", scenarios, values).withColumn("scenario", F.lit("Average"))
    return rows.unionByName(average)


def gap_summary(cells_: DataFrame, values: Sequence[str] = ("auroc", "auprc")) -> DataFrame:
    """In-domain and leave-one-domain-out means per method, their gap and whether it is small.

    One conditional aggregation instead of a self join.
    """
    out = []
    for v in values:
        for short, members in (("id", IN_DOMAIN), ("lodo", LODO)):
            x = F.when(F.col("scenario").isin(*members), F.col(v))
            out.append(F.when(F.count(x) == len(members), F.avg(x)).alias(f"{short}_{v}"))
    means = cells_.groupBy("extractor", "engine").agg(*out)
    for v in values:
        means = means.withColumn(f"gap_{v}", F.col(f"lodo_{v}") - F.col(f"id_{v}"))
        means = means.withColumn(f"small_gap_{v}", F.col(f"gap_{v}") > SMALL_GAP)
    return means


def drift_summary(cells_: DataFrame) -> DataFrame:
    """Origin and shifted AUROC averaged over the domains, change = shifted - origin."""
    m = strict_mean(cells_, ["extractor", "engine"], "domain", DOMAINS, ["auroc_s1", "auroc_s2"])
    return m.withColumn("delta", F.col("auroc_s2") - F.col("auroc_s1"))


def size_table(full: DataFrame, big: DataFrame, regimes: dict[str, Sequence[str]], value: str = "auroc") -> DataFrame:
    """Full-size against double-size means per (extractor, regime)."""
    out = None
    for regime, members in regimes.items():
        a = strict_mean(full, ["extractor"], "scenario", members, [value]).withColumnRenamed(value, "full")
        b = strict_mean(big, ["extractor"], "scenario", members, [value]).withColumnRenamed(value, "big")
        one = a.join(b, "extractor").withColumn("regime", F.lit(regime)).withColumn("delta", F.col("big") - F.col("full"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- best values and rankings ---------------------------------------------------------


def mark_best(table: DataFrame, values: Sequence[str] = BEST_METRICS) -> DataFrame:
    """Add ``best_<value>`` flags: equal to the column's maximum, missing values ignored."""
    top = table.agg(*[F.max(v).alias(v) for v in values]).first()
    flag = lambda v: F.coalesce(F.col(v) == F.lit(top[v]), F.lit(False))
    return table.withColumns({f"best_{v}": flag(v) for v in values})


def recall_heatmap(cells_: DataFrame, keys: Sequence[str] = ("extractor", "engine")) -> DataFrame:
    """Integer percent recall per technique (halves to even), one column each."""
    return cells_.select(
        *keys, *[F.bround(F.col(f"recall_{t}") * 100.0, 0).cast("int").alias(t) for t in TECHNIQUES]
    )


def top_by(cells_: DataFrame, value: str = "f1", k: int = 3, names: Sequence[str] = ("extractor", "engine")) -> DataFrame:
    """The ``k`` rows with the highest value; missing values never rank."""
    return cells_.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *names).limit(k)


def best_against_baselines(cells_: DataFrame, baselines: Sequence[str], prefix: str = "trace-", k: int = 3) -> DataFrame:
    """The best trace-based methods by F1 over all baseline rows, best values marked over both blocks."""
    top = top_by(cells_.where(F.col("extractor").startswith(prefix)), "f1", k).withColumn("block", F.lit("top"))
    base = cells_.where(F.col("extractor").isin(*baselines)).withColumn("block", F.lit("baseline"))
    return mark_best(top.unionByName(base))


# ---- few-shot -----------------------------------------------------------------------


def fewshot_curve(runs: DataFrame, experiments: Sequence[str] | None = None) -> DataFrame:
    """(extractor, k, auroc): mean over the targets, kept when all four targets are there."""
    rows = with_cell_tags(finished_runs(runs, None, experiments))
    rows = rows.where((F.col("setting") == "few_shot") & (F.col("engine") == "ae"))
    rows = rows.withColumn("k", param("k").try_cast("int"))
    latest = latest_value(rows, ["extractor", "target", "k"], metric("auroc"), "auroc")
    curve = latest.where(F.col("target").isin(*DOMAINS)).groupBy("extractor", "k")
    return curve.agg(F.count_distinct("target").alias("_n"), F.avg("auroc").alias("auroc")).where(
        F.col("_n") == len(DOMAINS)
    ).drop("_n")


def indomain_reference(runs: DataFrame, experiments: Sequence[str] | None = None) -> DataFrame:
    """(extractor, reference): in-domain autoencoder AUROC averaged over all four scenarios."""
    rows = with_cell_tags(finished_runs(runs, experiments=experiments)).where(F.col("engine") == "ae")
    latest = latest_value(rows, ["extractor", "scenario"], metric("roc_auc"), "reference")
    return strict_mean(latest, ["extractor"], "scenario", IN_DOMAIN, ["reference"]).where("reference IS NOT NULL")


def recovery(curve: DataFrame, reference: DataFrame, margin: float = RECOVERY_MARGIN) -> DataFrame:
    """Smallest k at most ``margin`` below the reference; NULL without reference or if never."""
    joined = curve.join(reference, "extractor", "left")
    hit = F.when(F.col("auroc") >= F.col("reference") - F.lit(margin), F.col("k"))
    return joined.groupBy("extractor").agg(F.max("reference").alias("reference"), F.min(hit).alias("recovery_k"))


# ---- latency ------------------------------------------------------------------------


def seconds_of(hms) -> Column:
    """Seconds of a HH:MM:SS.ffffff text."""
    c = F.col(hms) if isinstance(hms, str) else hms
    p = F.split(c, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("double")


def latency_points(aurocs: DataFrame, measured: DataFrame, benchmarked: DataFrame) -> DataFrame:
    """AUROC against ms per query: measured totals first, benchmark where there is none.

    Inputs are keyed by (engine, extractor): ``auroc``, ``ms``, ``ms``.
    """
    keys = ["engine", "extractor"]
    both = measured.withColumnRenamed("ms", "_a").join(benchmarked.withColumnRenamed("ms", "_b"), keys, "full")
    lat = both.select(*keys, F.coalesce("_a", "_b").alias("ms"))
    return aurocs.dropna(subset=["auroc"]).join(lat.dropna(subset=["ms"]), keys)


def newest_of_spellings(runs: DataFrame, scenario: str, method: str) -> DataFrame:
    """Newest full run per extractor under either engine tag, whatever its status."""
    rows = runs.where((tag("scenario") == scenario) & (F.element_at("tags", "run_type") == "full-run"))
    spelled = rows.where(F.element_at("tags", "decision_engine") == method).unionByName(
        rows.where(F.element_at("tags", "pipeline") == method)
    )
    return latest_run(spelled.withColumn("extractor", tag("feature_extractor")), ["extractor"], {"run": F.col("run_id")})
