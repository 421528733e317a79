"""Session helpers: lineage cuts on shared storage and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it holds at most this many (narrow) rows.
SMALL_ROWS = 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, or a local one in tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-vigilar-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables next to the checkpoints, so on storage that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    Used where a result is read by many later jobs (training passes, several
    metrics): losing an executor then costs a re-read, not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows; else leave it as it is.

    The rows are fetched once (never more than ``max_rows + 1``). A larger side goes
    into an ordinary shuffle join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
