"""Online scoring: a stream of query rows through a fitted detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilar.plans.detector import Detector


def score_stream(stream: DataFrame, detector: Detector, threshold: float, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Stateless append stream of (kept columns..., score, alert) for row-wise heads (ae, ocsvm)."""
    if detector.method == "lof":
        raise ValueError("neighbour search needs the fit table; use start_scoring")
    scored = detector.score(stream, keep)
    return scored.withColumn("alert", (F.col("score") > F.lit(float(threshold))).cast("int"))


def start_scoring(
    stream: DataFrame, detector: Detector, threshold: float, path: str, checkpoint: str, keep: tuple[str, ...] = ("row_id",), trigger: dict | None = None,
) -> StreamingQuery:
    """Score every micro-batch and append it to a Parquet table; works for all heads.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes (``{"processingTime": "10 seconds"}`` for a
    stream that goes on); by default all that is there is scored, then the stream stops. The batch id is part of the output layout, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = detector.score(batch, keep)
        scored = scored.withColumn("alert", (F.col("score") > F.lit(float(threshold))).cast("int"))
        (
            scored.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
