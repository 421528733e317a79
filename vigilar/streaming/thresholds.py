"""Running thresholds: a stateful stream that calibrates itself, key by key.

Every key (a source, a tenant, a kind of statement) keeps a histogram of the scores it has seen, in bins of
constant relative width. A row is judged by the quantile of the rows of its key before it, in the order of
an event column, and then counted. Bins are bounded in number, so is the state of a key; counts add up, so
the result does not depend on how rows fall into micro-batches, as long as these come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELATIVE_ERROR = 0.01
LOW, HIGH = 1e-9, 1e9  # smaller sizes count as nothing, larger ones as this
_GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
_SIDE = int(np.ceil(np.log(HIGH / LOW) / np.log(_GAMMA))) + 1  # bins on each side of zero


def score_bins(scores: np.ndarray) -> np.ndarray:
    """Bin of every score, from -_SIDE to _SIDE, ordered as the scores are; 0 is nothing."""
    size = np.clip(np.abs(scores), 0, HIGH)
    place = np.where(size <= LOW, 0, np.ceil(np.log(np.maximum(size, LOW) / LOW) / np.log(_GAMMA)))
    return (np.sign(scores) * np.minimum(place, _SIDE)).astype(np.int64)


def bin_value(place: int) -> float:
    """A score of the bin, at most ``RELATIVE_ERROR`` from all of its scores."""
    if place == 0:
        return 0.0
    return float(np.sign(place) * LOW * _GAMMA ** abs(place) * 2 / (_GAMMA + 1))


def judge(counts: np.ndarray, scores: np.ndarray, target_fpr: float, warm_up: int) -> np.ndarray:
    """Threshold before every score (NaN until ``warm_up`` were seen); adds the scores to ``counts``."""
    out, total = np.full(len(scores), np.nan), int(counts.sum())
    for i, place in enumerate(score_bins(scores)):
        if total >= warm_up:
            rank = int(np.floor((1.0 - target_fpr) * (total - 1)))
            out[i] = bin_value(int(np.searchsorted(np.cumsum(counts), rank, side="right")) - _SIDE)
        counts[place + _SIDE] += 1
        total += 1
    return out


class RunningThreshold(StatefulProcessor):
    """State: bins of the key that are not empty."""

    def __init__(self, key: str, order: str, target_fpr: float, warm_up: int) -> None:
        self.key, self.order, self.target_fpr, self.warm_up = key, order, target_fpr, warm_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = handle.getMapState("bins", "place long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values([self.order, "score"], kind="stable")
        counts = np.zeros(2 * _SIDE + 1, dtype=np.int64)
        for (place,), (n,) in self.bins.iterator():
            counts[place + _SIDE] = n
        before = counts.copy()
        threshold = judge(counts, batch["score"].to_numpy(dtype=float), self.target_fpr, self.warm_up)
        for at in np.flatnonzero(counts != before).tolist():
            self.bins.updateValue((at - _SIDE,), (int(counts[at]),))
        alert = (batch["score"].to_numpy(dtype=float) > threshold).astype("int32")
        yield pd.DataFrame({self.key: key[0], self.order: batch[self.order], "score": batch["score"], "threshold": threshold, "alert": alert})

    def close(self) -> None:
        pass


def running_thresholds(scored: DataFrame, key: str, order: str, target_fpr: float = 0.001, warm_up: int = 100) -> DataFrame:
    """(key, order, score, threshold, alert) for every row of a stream of scores; needs the RocksDB state store.

    Rows without a key or score are left out. A key's rows of one micro-batch are judged in one task.
    """
    kind = scored.schema
    schema = f"`{key}` {kind[key].dataType.simpleString()}, `{order}` {kind[order].dataType.simpleString()}, score double, threshold double, alert int"
    rows = scored.where(F.col(key).isNotNull() & F.col("score").isNotNull()).select(key, order, F.col("score").cast("double").alias("score"))
    return rows.groupBy(key).transformWithStateInPandas(RunningThreshold(key, order, target_fpr, warm_up), schema, "append", "None")


def start_thresholds(
    scored: DataFrame, path: str, checkpoint: str, key: str, order: str, target_fpr: float = 0.001, warm_up: int = 100, trigger: dict | None = None,
) -> StreamingQuery:
    """Append judged rows to a Parquet table by batch, so that a batch that is run again after a crash replaces itself.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes; by default all that is there, then stop.
    """
    spark = scored.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold"))).withColumn("batch_id", F.lit(batch_id))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    out = running_thresholds(scored, key, order, target_fpr, warm_up).writeStream.outputMode("append").foreachBatch(write)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
