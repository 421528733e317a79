"""Running totals over a globally ordered column, without a one-task sort.

``Window.orderBy`` without a partition key sorts everything in one task, and with a
key it sorts the largest key's rows in one task. Here equal values are collapsed
first, a large key is cut into ordered value buckets, every bucket is summed on its
own, and the exclusive prefix of the (few) bucket totals is added back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 4096
_FAN = 64


@dataclass(frozen=True)
class Buckets:
    """Value boundaries of the keys that are too large for one task."""

    keys: tuple[str, ...]
    bounds: DataFrame | None  # keys..., _edges ARRAY<ARRAY<DOUBLE>>, _outer ARRAY<DOUBLE>

    def assign(self, df: DataFrame, value: str) -> DataFrame:
        """Add ``_bucket``, which never decreases as ``value`` grows within a key."""
        if self.bounds is None:
            return df.withColumn("_bucket", F.lit(0))
        v = F.col(value)
        if self.keys:
            df = df.join(F.broadcast(self.bounds), list(self.keys), "left")
        else:
            row = self.bounds.first()
            df = df.withColumn("_outer", _doubles(row["_outer"])).withColumn(
                "_edges", F.array(*[_doubles(e) for e in row["_edges"]])
            )
        outer = F.size(F.filter("_outer", lambda x: x < v))
        inner = F.size(F.filter(F.get(F.col("_edges"), outer), lambda x: x < v))
        bucket = F.when(F.col("_outer").isNull(), F.lit(0)).otherwise(outer * _FAN + inner)
        return df.withColumn("_bucket", bucket).drop("_outer", "_edges")


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def plan_buckets(
    df: DataFrame, keys: list[str], value: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> Buckets:
    """Find keys with more than ``rows_per_bucket`` rows and approximate quantiles for them.

    Only boundaries reach the driver; their number is at most rows / rows_per_bucket.
    They only steer how work is split, so their being approximate changes no result.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_bucket)
    hot = counts.collect()
    if not hot:
        return Buckets(tuple(keys), None)
    spark = df.sparkSession
    key_fields = [df.schema[k] for k in keys]
    n_buckets = {tuple(r[k] for k in keys): min(MAX_BUCKETS, -(-r["_n"] // rows_per_bucket)) for r in hot}
    most = max(n_buckets.values())
    fractions = [i / most for i in range(1, most)]
    part = df
    if keys:
        hot_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], T.StructType(key_fields))
        part = df.join(F.broadcast(hot_keys), keys, "left_semi")
    edges = (
        part.groupBy(*keys)
        .agg(F.percentile_approx(F.col(value).cast("double"), fractions, 4 * MAX_BUCKETS).alias("_q"))
        .collect()
    )
    rows = []
    for r in edges:
        q = sorted(set(r["_q"]))
        chunks = [q[i : i + _FAN - 1] for i in range(0, len(q), _FAN)]
        outer = [q[i + _FAN - 1] for i in range(0, len(q), _FAN) if i + _FAN - 1 < len(q)]
        if len(chunks) == len(outer):
            chunks.append([])
        rows.append((*[r[k] for k in keys], outer, chunks))
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("_outer", T.ArrayType(T.DoubleType())),
            T.StructField("_edges", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    return Buckets(tuple(keys), spark.createDataFrame(rows, schema))


def running_totals(
    df: DataFrame,
    keys: list[str],
    value: str,
    measures: dict[str, Column],
    *,
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    buckets: Buckets | None = None,
) -> DataFrame:
    """One row per distinct (keys, value) with, for every measure ``m``:

    ``m`` (its sum at this value), ``cum_m`` (inclusive running sum in value order),
    ``total_m`` (sum over the key) and ``next_m`` (``m`` at the following value).
    """
    if buckets is None:
        buckets = plan_buckets(df, keys, value, rows_per_bucket)
    names = list(measures)
    collapsed = df.groupBy(*keys, value).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    direction = F.col(value).desc() if descending else F.col(value).asc()

    if buckets.bounds is None:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        w = whole.orderBy(direction)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return collapsed.select(
            *keys,
            value,
            *names,
            *[F.sum(m).over(run).alias(f"cum_{m}") for m in names],
            *[F.sum(m).over(whole).alias(f"total_{m}") for m in names],
            *[F.lead(m).over(w).alias(f"next_{m}") for m in names],
        )

    placed = buckets.assign(collapsed, value)
    edge = F.max_by if descending else F.min_by
    totals = placed.groupBy(*keys, "_bucket").agg(
        *[F.sum(m).alias(f"_sum_{m}") for m in names],
        *[edge(m, value).alias(f"_first_{m}") for m in names],
    )
    b_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    b_whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    b_w = b_whole.orderBy(b_order)
    before = b_w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in names],
        *[F.sum(f"_sum_{m}").over(b_whole).alias(f"total_{m}") for m in names],
        *[F.lead(f"_first_{m}").over(b_w).alias(f"_after_{m}") for m in names],
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(direction)
    l_run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select(
        *keys,
        value,
        "_bucket",
        *names,
        *[F.sum(m).over(l_run).alias(f"_cum_{m}") for m in names],
        *[F.lead(m).over(local).alias(f"_next_{m}") for m in names],
    )
    return summed.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        value,
        *names,
        *[(F.col(f"_cum_{m}") + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in names],
        *[F.col(f"total_{m}") for m in names],
        *[F.coalesce(f"_next_{m}", f"_after_{m}").alias(f"next_{m}") for m in names],
    )
