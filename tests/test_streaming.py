"""Running thresholds: the rule row by row, bounded error, and equal output after a crash and a restart."""

import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vigilar.streaming import thresholds as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows():
    rng = np.random.default_rng(4)
    out = [(i, "hot" if i % 3 else f"k{i % 7}", float(rng.normal(0, 1) ** 3 + (30 if i % 97 == 5 else 0))) for i in range(1800)]
    return out + [(5000, None, 1.0), (5001, "k1", None)]


def expected(data, fpr=0.05, warm_up=30):
    seen, out = {}, {}
    for i, key, score in sorted(data, key=lambda r: r[0]):
        if key is None or score is None:
            continue
        before = seen.setdefault(key, [])
        exact = None
        if len(before) >= warm_up:
            exact = sorted(before)[math.floor((1 - fpr) * (len(before) - 1))]
        out[i] = (key, exact)
        before.append(score)
    return out


def write_files(folder, data, files=6):
    folder.mkdir(exist_ok=True)
    for f in range(files):
        part = pd.DataFrame([r for r in data if r[0] * files // 1800 == f or (f == files - 1 and r[0] >= 1800)], columns=["row_id", "key", "score"])
        part.astype({"row_id": "int64"}).to_parquet(folder / f"part-{f}.parquet")


def stream(spark, folder, per_batch):
    return spark.readStream.schema("row_id long, key string, score double").option("maxFilesPerTrigger", per_batch).parquet(str(folder))


def judged(spark, path):
    return {r.row_id: (r.key, r.score, r.threshold, r.alert) for r in spark.read.parquet(path).collect()}


def test_bins_keep_the_order_and_the_error():
    scores = np.concatenate([-np.logspace(8, -8, 500), [0.0], np.logspace(-8, 8, 500)])
    bins = T.score_bins(scores)
    assert (np.diff(bins) >= 0).all() and abs(bins).max() <= T._SIDE
    values = np.array([T.bin_value(int(b)) for b in bins])
    assert (np.abs(values - scores) <= T.RELATIVE_ERROR * np.abs(scores) + 2 * T.LOW).all()
    assert T.score_bins(np.array([1e30, -1e30, 1e-30])).tolist() == [T.score_bins(np.array([T.HIGH]))[0], T.score_bins(np.array([-T.HIGH]))[0], 0]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Output of one run without a break, a file a batch."""
    tmp = tmp_path_factory.mktemp("whole")
    write_files(tmp / "in", rows())
    T.start_thresholds(stream(spark, tmp / "in", 1), str(tmp / "out"), str(tmp / "check"), "key", "row_id", 0.05, 30).awaitTermination()
    return judged(spark, str(tmp / "out"))


def test_rows_are_judged_by_those_before_them(whole):
    want = expected(rows())
    assert whole.keys() == want.keys()
    for i, (key, exact) in want.items():
        got_key, score, threshold, alert = whole[i]
        assert got_key == key and (threshold is None) == (exact is None)
        if exact is not None:
            assert abs(threshold - exact) <= 2 * T.RELATIVE_ERROR * abs(exact) + 1e-6
            assert alert == int(score > threshold)
    assert sum(a for *_, a in whole.values()) > 15


def test_batches_of_another_size_give_the_same(spark, whole, tmp_path):
    write_files(tmp_path / "in", rows())
    T.start_thresholds(stream(spark, tmp_path / "in", 4), str(tmp_path / "out"), str(tmp_path / "check"), "key", "row_id", 0.05, 30).awaitTermination()
    assert judged(spark, str(tmp_path / "out")) == whole


def test_crash_and_restart(spark, whole, tmp_path):
    """The third batch is written, then the run dies before the batch is committed; the next run repeats it."""
    write_files(tmp_path / "in", rows())
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    died = []

    def write(batch, batch_id):
        batch.withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold"))).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(out)
        if batch_id == 2:
            died.append(batch_id)
            raise RuntimeError("lost here")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.ROCKSDB)
    first = T.running_thresholds(stream(spark, tmp_path / "in", 1), "key", "row_id", 0.05, 30).writeStream.foreachBatch(write)
    query = first.option("checkpointLocation", check).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost here"):
        query.awaitTermination()
    assert died == [2] and len(judged(spark, out)) < len(whole)
    T.start_thresholds(stream(spark, tmp_path / "in", 1), out, check, "key", "row_id", 0.05, 30, {"availableNow": True}).awaitTermination()
    assert judged(spark, out) == whole
