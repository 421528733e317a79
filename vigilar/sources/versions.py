"""Result tables with versions: a log of commits decides which files are live, so writers never mix.

Data go to a folder of their own. A commit is one small file in the log, whose name is the next version: who
creates it first has the version, others take the next. It names the cells (keys) that the folder
holds. A reader takes every cell from the folder of its newest commit, so a cell is always what one
writer wrote, whole; data without a commit are never seen, and ``vacuum`` removes them.

The log needs a file system that refuses to create a file twice (HDFS, local disks, object stores with
conditional writes). Rows go through Spark only; the driver handles names and the keys of cells.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOG_SCHEMA = "version long, folder string, cell map<string,string>, _broken string"


class ConflictError(RuntimeError):
    """A cell was committed by somebody else since the version that the writer had read."""


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def last_version(spark: SparkSession, path: str) -> int:
    """The newest version; 0 before the first commit."""
    return max((int(n.removesuffix(".json")) for n in _names(spark, f"{path}/_log") if n.endswith(".json")), default=0)


def _claim(spark: SparkSession, path: str, version: int, lines: list[str]) -> bool:
    """Create the log file of a version; False if it exists."""
    fs, name = _fs(spark, f"{path}/_log/{version:012d}.json")
    try:
        out = fs.create(name, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception):
            return False
        raise
    try:
        out.write(bytearray("\n".join(lines).encode()))
    finally:
        out.close()
    return True


def live_cells(spark: SparkSession, path: str, cell: Sequence[str], version: int | None = None) -> DataFrame:
    """(cell keys..., folder, version): where every cell lives at a version (the newest by default)."""
    fs, log = _fs(spark, f"{path}/_log")
    empty = spark.createDataFrame([], "version long, folder string, " + ", ".join(f"`{c}` string" for c in cell))
    if not fs.exists(log):
        return empty.select(*cell, "folder", "version")
    reader = spark.read.schema(_LOG_SCHEMA).option("columnNameOfCorruptRecord", "_broken")
    entries = reader.json(f"{path}/_log").where(F.col("version").isNotNull() & F.col("folder").isNotNull())
    if version is not None:
        entries = entries.where(F.col("version") <= version)
    newest = F.row_number().over(Window.partitionBy("cell_key").orderBy(F.desc("version")))
    named = entries.withColumn("cell_key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("cell")))))
    return named.withColumn("_r", newest).where(F.col("_r") == 1).select(*[F.element_at("cell", c).alias(c) for c in cell], "folder", "version")


def commit(results: DataFrame, path: str, cell: Sequence[str], expected: int | None = None) -> int:
    """Write rows of whole cells; they replace what the cells held. Returns the version.

    With ``expected`` (the version that the rows were derived from) the commit is refused
    if any of its cells was committed since. A crash before the commit leaves data that nobody reads.
    """
    spark, cell = results.sparkSession, list(cell)
    folder = uuid.uuid4().hex
    results.write.partitionBy(*cell).parquet(f"{path}/data/{folder}")
    return publish(spark, path, folder, cell, expected)


def publish(spark: SparkSession, path: str, folder: str, cell: Sequence[str], expected: int | None = None) -> int:
    """Commit the cells of a data folder that is written."""
    written = spark.read.parquet(f"{path}/data/{folder}").select(*[F.col(c).cast("string").alias(c) for c in cell]).distinct().collect()
    cells = [{c: r[c] for c in cell} for r in written]
    while True:
        at = last_version(spark, path)
        if expected is not None and at > expected:
            changed = live_cells(spark, path, cell).where(F.col("version") > expected).collect()
            taken = [c for c in cells if any(all(r[k] == c[k] for k in cell) for r in changed)]
            if taken:
                raise ConflictError(f"committed since version {expected}: {taken[:3]}")
        if _claim(spark, path, at + 1, [json.dumps({"version": at + 1, "folder": folder, "cell": c}) for c in cells]):
            return at + 1


def read_version(spark: SparkSession, path: str, cell: Sequence[str], version: int | None = None) -> DataFrame:
    """All live rows at a version. Files of cells that are not live are not read: folder and keys are partitions."""
    cell = list(cell)
    live = live_cells(spark, path, cell, version).select("folder", *cell)
    folders = [r["folder"] for r in live.select("folder").distinct().collect()]
    if not folders:
        raise ValueError(f"{path} has no committed version")
    out = None
    for folder in folders:  # a plan for each commit that still has live cells, not for each cell
        rows = spark.read.option("basePath", f"{path}/data/{folder}").parquet(f"{path}/data/{folder}")
        own = F.broadcast(live.where(F.col("folder") == folder).select(*[F.col(c).alias(f"_{c}") for c in cell]))  # a row a cell
        part = rows.join(own, [rows[c].cast("string").eqNullSafe(F.col(f"_{c}")) for c in cell], "leftsemi")
        out = part if out is None else out.unionByName(part)
    return out


def vacuum(spark: SparkSession, path: str, cell: Sequence[str], keep: Sequence[str] = ()) -> list[str]:
    """Delete data folders without a live cell, but those in ``keep`` (writers at work); returns their names."""
    live = {r["folder"] for r in live_cells(spark, path, cell).select("folder").distinct().collect()}
    gone = sorted(set(_names(spark, f"{path}/data")) - live - set(keep))
    for name in gone:
        fs, folder = _fs(spark, f"{path}/data/{name}")
        fs.delete(folder, True)
    return gone
