"""Intermediate tables on the storage that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilar.session import ensure_checkpoint_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back.

    Lineage ends there: a lost executor costs a re-read. The folder belongs to the
    application's checkpoint folder and goes with it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_by_hash(df: DataFrame, limit: int, *key: str) -> DataFrame:
    """The ``limit`` rows with the smallest hash of ``key``: a bounded sample for fitting.

    Of a large table, rows that cannot be among them are left out before the sort, so that
    what the last task reads is bounded as well.
    """
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    n = df.count()
    few = df.where(h < int((1 << 40) * (4 * limit / n))) if n > 4 * limit else df
    return few.orderBy(h, *key).limit(limit)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to.

    Its cleaner follows the collection of garbage on the driver, which a small driver heap may
    put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
