"""Queries on tables that are folders of files, as large tables are, and on single files."""

import shutil

import pytest

from vigilar.sources import scenarios as SC
from vigilar.sources.tables import table, table_stream
from vigilar.workload import QUERIES

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    for name in TABLES:
        if name in ("documents", "events"):
            table(spark, sf, name).repartition(3).write.parquet(f"{root}/{name}.parquet")
        else:
            shutil.copy(f"{sf}/{name}.parquet", root)
    return str(root)


def test_file_integrity_takes_folders(spark, folders):
    got = {r["file"]: r["status"] for r in QUERIES["file_integrity"](spark, folders).collect()}
    assert got == {f"{n}.parquet": "bad_hash" if n == "events" else "ok" for n in TABLES}


def test_a_folder_has_the_worst_status_of_its_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name in ("a", "b"):
        (tmp_path / "t" / name).write_text(name)
    (tmp_path / "u").write_text("u")
    entries = spark.createDataFrame(
        [("main", "t/a", 1, None, "0cc175b9c0f1b6a831c399e269772661"), ("main", "t/b", 2, None, "x"), ("main", "t/c", 1, None, "x"), ("main", "u", 1, None, None)],
        "grp string, file string, bytes long, sha256 string, md5 string",
    )
    worst = lambda rows: {r["file"]: r["status"] for r in SC.verify_tables(rows, str(tmp_path)).collect()}
    assert worst(entries) == {"t": "missing", "u": "unchecked"}
    assert worst(entries.where("file <> 't/c'")) == {"t": "bad_size", "u": "unchecked"}
    assert worst(entries.where("file = 't/a'")) == {"t": "ok"}


def test_streams_take_files_and_folders(spark, sf, folders, tmp_path):
    ids = {r[0] for r in table(spark, sf, "documents").select("doc_id").collect()}
    for at in (sf, folders):
        out = str(tmp_path / at.strip("/").replace("/", "_"))
        job = table_stream(spark, at, "documents").select("doc_id").writeStream.format("parquet").option("checkpointLocation", f"{out}_c")
        job.trigger(availableNow=True).start(out).awaitTermination()
        got = [r[0] for r in spark.read.parquet(out).collect()]
        assert len(got) == len(ids) and set(got) == ids


def test_running_thresholds_take_folders(spark, sf, folders):
    rows = lambda at: sorted(tuple(r) for r in QUERIES["stream_running_thresholds"](spark, at).collect())
    assert rows(folders) == rows(sf)
