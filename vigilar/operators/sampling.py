"""Deterministic sampling and splitting by hashed row ids.

A row's place in a draw is the order of ``md5(purpose:seed:row_id)``. Every kind of draw has a
purpose of its own: a cap, a fraction, the calibration split and the adaptation budgets are then
independent of each other, also with one seed. Exact sample sizes come from a histogram of the hash prefixes: whole prefixes below the cut-off are kept by a
plain filter, and only rows sharing the one cut-off prefix are ranked. Nothing is
sorted globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilar.session import small_side

_PREFIX = 5  # hex digits of the hash in the histogram: about a million buckets


# What a draw is for; the first part of what is hashed.
CAP, SAMPLE, FRACTION, SPLIT, BUDGET, TEMPLATE, LANDMARK, BLOCK = "cap", "sample", "fraction", "split", "budget", "template", "landmark", "block"


def order_hash(purpose: str, seed, row_id: str = "row_id") -> Column:
    """The hash that orders rows for a purpose and a seed (a literal or a column)."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(F.lit(f"{purpose}:"), seed_col.cast("string"), F.lit(":"), F.col(row_id).cast("string")))


def fraction_bound(fraction: float) -> str:
    """Hex string below which a share ``fraction`` of all hashes falls."""
    return "g" if fraction >= 1 else format(int(fraction * 2**32), "08x")


def in_fraction(purpose: str, fraction: float, seed, row_id: str = "row_id") -> Column:
    """True for the share ``fraction`` of rows whose hash comes first."""
    return order_hash(purpose, seed, row_id) < F.lit(fraction_bound(fraction))


def sample_fraction(df: DataFrame, fraction: float, seed=7, row_id: str = "row_id") -> DataFrame:
    """Keep about a share ``fraction`` of the rows."""
    return df.where(in_fraction(FRACTION, fraction, seed, row_id))


def fit_val_roles(df: DataFrame, val_fraction: float = 0.1, seed=7, row_id: str = "row_id") -> DataFrame:
    """Add ``role``: ``val`` for the calibration share, ``fit`` for the rest."""
    return df.withColumn("role", F.when(in_fraction(SPLIT, val_fraction, seed, row_id), "val").otherwise("fit"))


def _first_rows(edge: DataFrame, groups: list[str], hash_col: str, row_id: str) -> DataFrame:
    """The first ``_rest`` rows per group. Equal rows (tables without unique ids may hold many
    copies) are counted before they are ranked and repeated afterwards."""
    counted = edge.groupBy(*edge.columns).agg(F.count(F.lit(1)).alias("_copies"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    w = whole.orderBy(hash_col, row_id).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.coalesce(F.sum("_copies").over(w), F.lit(0))
    kept = counted.withColumn("_keep", F.least(F.col("_copies"), left)).where(F.col("_keep") > 0)
    return kept.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_keep")))).select(*edge.columns)


def take_first(
    df: DataFrame, groups: Sequence[str], targets: DataFrame, hash_col: str, row_id: str = "row_id"
) -> DataFrame:
    """Keep, in every group, the ``_target`` rows with the smallest ``hash_col``.

    ``targets`` has the group columns and ``_target``. Groups of any size are handled by
    the prefix histogram.
    """
    groups = list(groups)
    prefix = F.substring(hash_col, 1, _PREFIX)
    hist = df.groupBy(*groups, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        hist.withColumn("_cum", F.sum("_n").over(w))
        .join(targets, groups)
        .where(F.col("_cum") - F.col("_n") < F.col("_target"))
        .groupBy(*groups)
        .agg(
            F.max("_prefix").alias("_cut"),
            F.max_by(F.col("_target") - F.col("_cum") + F.col("_n"), "_prefix").alias("_rest"),
        )
    )
    marked = df.join(small_side(cuts), groups).withColumn("_prefix", prefix)
    below = marked.where(F.col("_prefix") < F.col("_cut"))
    edge = _first_rows(marked.where(F.col("_prefix") == F.col("_cut")), groups, hash_col, row_id)
    return below.unionByName(edge).drop("_prefix", "_cut", "_rest")


def sample_n(df: DataFrame, n: int | None, seed=7, row_id: str = "row_id") -> DataFrame:
    """A sample of exactly ``min(n, rows)`` rows, without strata."""
    if n is None:
        return df
    hashed = df.withColumn("_h", order_hash(SAMPLE, seed, row_id)).withColumn("_prefix", F.substring("_h", 1, _PREFIX))
    hist = hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(F.lit(0)).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = hist.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).where(F.col("_before") < n)
    cut = before.agg(F.max("_prefix").alias("at"), F.max("_before").alias("before")).first()
    if cut["at"] is None:
        return df.limit(0)
    edge = hashed.where(F.col("_prefix") == cut["at"]).withColumn("_rest", F.lit(n - cut["before"]))
    edge = _first_rows(edge, [], "_h", row_id).drop("_rest")
    return hashed.where(F.col("_prefix") < cut["at"]).unionByName(edge).drop("_h", "_prefix")


def stratified_cap(
    df: DataFrame,
    limit: int | None,
    seed=0,
    *,
    groups: Sequence[str] = (),
    label: str = "label",
    row_id: str = "row_id",
    limit_col: Column | None = None,
) -> DataFrame:
    """Cut every group to about ``limit`` rows, each label keeping its share.

    A label with ``c`` of the group's ``n`` rows keeps ``round(c * limit / n)`` rows
    (halves to even); groups with ``n <= limit`` stay whole. ``limit_col`` gives a
    limit per group, computed from the group's counts (``n``).
    """
    if limit is None and limit_col is None:
        return df
    groups = list(groups)
    per_label = df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    per_label = per_label.withColumn("n", F.sum("_c").over(whole))
    per_label = per_label.withColumn("_limit", F.lit(limit) if limit_col is None else limit_col)
    share = F.bround(F.col("_c") * (F.col("_limit").cast("double") / F.col("n").cast("double")), 0)
    targets = per_label.select(
        *groups,
        label,
        F.when(F.col("n") <= F.col("_limit"), F.col("_c")).otherwise(share.cast("long")).alias("_target"),
    )
    hashed = df.withColumn("_h", order_hash(CAP, seed, row_id))
    return take_first(hashed, [*groups, label], targets, "_h", row_id).drop("_h")


def prefix_samples(
    df: DataFrame, ks: Sequence[int], seeds: Sequence[int], row_id: str = "row_id"
) -> DataFrame:
    """For every seed an ordered sample of the largest k; smaller k are its prefixes.

    Returns (k, seed, place, columns...). The sample of the largest k is drawn once per
    seed, so every row is featurised once.
    """
    ks = sorted({k for k in ks if k > 0})
    if not ks:
        return df.limit(0).select(F.lit(0).alias("k"), F.lit(0).alias("seed"), F.lit(0).alias("place"), "*")
    drawn = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    drawn = drawn.withColumn("_h", order_hash(BUDGET, F.col("seed"), row_id))
    targets = drawn.sparkSession.createDataFrame([(s, ks[-1]) for s in seeds], "seed int, _target long")
    largest = take_first(drawn, ["seed"], targets, "_h", row_id)
    place = F.row_number().over(Window.partitionBy("seed").orderBy("_h", row_id))  # at most max(k) rows per seed
    ranked = largest.withColumn("place", place).drop("_h")
    fits = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("place"))
    return ranked.withColumn("k", F.explode(fits)).select("k", "seed", "place", *df.columns)


def template_halves(
    df: DataFrame, by: str = "statement_type", template: str = "query_template_id", seed=7
) -> DataFrame:
    """Split the templates of every statement type in two; add ``drift_set``.

    The first half (by hash order, the larger one if odd) is ``origin``, the rest ``shifted``.
    """
    w = Window.partitionBy(by).orderBy(order_hash(TEMPLATE, seed, template), template)
    halves = df.select(by, template).distinct().withColumn("_half", F.ntile(2).over(w))
    halves = halves.withColumn("drift_set", F.when(F.col("_half") == 1, "origin").otherwise("shifted")).drop("_half")
    return df.drop("drift_set").join(small_side(halves), [by, template])
