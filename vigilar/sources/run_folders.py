"""Run logs kept as folders: an experiment is a folder of runs, a run a folder of small files.

    root/<experiment>/meta.yaml              name, lifecycle_stage
    root/<experiment>/<run>/meta.yaml        status, start_time in milliseconds, lifecycle_stage
    root/<experiment>/<run>/params/<key>     the value
    root/<experiment>/<run>/tags/<key>       the value
    root/<experiment>/<run>/metrics/<key>    a line "time value step" for every point

Keys may contain slashes. Files are listed and read by Spark, on any storage it knows; other folders of a
run (its artifacts) are not listed. Names of experiments select folders before anything in them is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilar.session import small_side

# How statuses are numbered in meta.yaml.
STATUSES = {"1": "RUNNING", "2": "SCHEDULED", "3": "FINISHED", "4": "FAILED", "5": "KILLED"}
SCHEMA = "run_id string, experiment string, status string, start_time timestamp, tags map<string,string>, params map<string,string>, metrics map<string,string>"


def _field(name: str) -> Column:
    """A top-level scalar of meta.yaml, quotes removed; NULL if it is missing or empty."""
    value = F.regexp_extract("text", rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    value = F.when(value.rlike(r"^'.*'$"), F.replace(F.substr(value, F.lit(2), F.length(value) - 2), F.lit("''"), F.lit("'"))).otherwise(F.regexp_replace(value, r'^"(.*)"$', "$1"))
    return F.when(~value.isin("", "null", "~"), value)


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame | None:
    """(path below ``root``, text) of the files that match, or None if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.makeQualified(path).toString().rstrip("/")
    if not fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{whole}/{pattern}")):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{whole}/{pattern}")
    return files.select(F.substr("path", F.lit(len(whole) + 2)).alias("path"), F.col("content").cast("string").alias("text"))


def _last_point() -> Column:
    """Value of the last point of a metric file: the greatest step, then time, then value."""
    points = F.filter(F.transform(F.split("text", "\n"), lambda x: F.split(F.trim(x), "[ \t]+")), lambda x: F.size(x) >= 2)
    at = lambda x, i: F.coalesce(F.get(x, F.lit(i)).try_cast("long"), F.lit(0))
    return F.array_max(F.transform(points, lambda x: F.struct(at(x, 2).alias("step"), at(x, 0).alias("time"), F.get(x, F.lit(1)).try_cast("double").alias("n"), F.get(x, F.lit(1)).alias("value"))))["value"]


def read_run_folders(spark: SparkSession, root: str, experiments: Sequence[str] | None = None) -> DataFrame:
    """A run log (see ``plans.reports``) of the active runs of active experiments, all or those named.

    Metrics are the text of their last point. Spark passes over empty files, so an empty value is a missing
    key. Runs without a meta.yaml are no runs; a folder without
    experiments gives an empty log.
    """
    metas = _files(spark, root, "*/meta.yaml")
    empty = spark.createDataFrame([], SCHEMA)
    if metas is None:
        return empty
    known = metas.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), _field("name").alias("experiment"), _field("lifecycle_stage").alias("stage"))
    known = known.where(F.coalesce(F.col("stage") == "active", F.lit(True))).drop("stage")
    folders = "*"
    if experiments is not None:
        chosen = [r.folder for r in known.where(F.col("experiment").isin(*experiments)).select("folder").collect()]  # as many as the caller named
        if not chosen:
            return empty
        known, folders = known.where(F.col("folder").isin(*chosen)), "{" + ",".join(sorted(chosen)) + "}"
    files = _files(spark, root, f"{folders}/*/{{meta.yaml,params,tags,metrics}}")
    if files is None:
        return empty
    parts = F.split("path", "/", 4)
    kind = F.get(parts, F.lit(2))
    files = files.select(F.get(parts, F.lit(0)).alias("folder"), F.get(parts, F.lit(1)).alias("run_id"), kind.alias("kind"), F.get(parts, F.lit(3)).alias("key"), "text")
    meta = F.when(F.col("kind") == "meta.yaml", F.struct(_field("status").alias("status"), _field("start_time").try_cast("long").alias("start_time"), _field("lifecycle_stage").alias("stage")))

    def entries(name: str, value: Column) -> Column:
        pair = F.when((F.col("kind") == name) & F.col("key").isNotNull(), F.struct("key", value.alias("value")))
        return F.map_from_entries(F.collect_list(pair)).alias(name)

    plain = F.regexp_replace("text", r"\r?\n$", "")
    runs = files.groupBy("folder", "run_id").agg(F.max(meta).alias("meta"), entries("tags", plain), entries("params", plain), entries("metrics", _last_point()))
    runs = runs.where(F.col("meta").isNotNull() & F.coalesce(F.col("meta.stage") == "active", F.lit(True))).join(small_side(known), "folder")
    names = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    status = F.coalesce(F.element_at(names, F.col("meta.status")), F.col("meta.status"))
    return runs.select("run_id", "experiment", status.alias("status"), F.timestamp_millis("meta.start_time").alias("start_time"), "tags", "params", "metrics")


def _write_rows(root: str):  # noqa: ANN202
    numbers = {v: k for k, v in STATUSES.items()}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pa_fs

        fs, base = pa_fs.FileSystem.from_uri(root)

        def put(path: str, text: str) -> None:
            """A file appears whole: a task that is tried again or twice writes the same."""
            folder = path.rsplit("/", 1)[0]
            fs.create_dir(folder, recursive=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(text.encode())
            fs.move(part, path)

        for batch in batches:
            for run in batch.to_dict("records"):
                home = f"{base}/{run['folder']}/{run['run_id']}"
                for kind in ("params", "tags", "metrics"):
                    for key, value in dict(run[kind] or {}).items():
                        if value is not None:
                            put(f"{home}/{kind}/{key}", f"{run['start_time']} {value} 0\n" if kind == "metrics" else str(value))
                put(f"{home}/meta.yaml", f"run_id: {run['run_id']}\nstatus: {numbers.get(run['status'], run['status'])}\nstart_time: {run['start_time']}\nlifecycle_stage: active\n")
                quoted = str(run["experiment"]).replace("'", "''")
                put(f"{base}/{run['folder']}/meta.yaml", f"experiment_id: '{run['folder']}'\nname: '{quoted}'\nlifecycle_stage: active\n")
            yield batch[["run_id"]]

    return rows


def write_run_folders(runs: DataFrame, root: str) -> int:
    """Write a run log as folders below ``root`` (an URI that all executors reach); gives the number of runs.

    Tasks write the files of their runs. An experiment's folder is named by a hash of its name.
    """
    text = {c: F.transform_values(c, lambda _, v: v.cast("string")) for c in ("tags", "params", "metrics")}
    rows = runs.withColumns({**text, "run_id": F.col("run_id").cast("string"), "start_time": F.coalesce(F.unix_millis(F.col("start_time").cast("timestamp")), F.lit(0)), "folder": F.substring(F.sha2("experiment", 256), 1, 16)})
    rows = rows.select("folder", "run_id", "experiment", "status", "start_time", "tags", "params", "metrics")
    return rows.mapInPandas(_write_rows(root), "run_id string").count()
