from pyspark.sql import functions as F

from vigilar.plans import reports as R
from vigilar.sources.run_folders import read_run_folders, write_run_folders
from vigilar.sources.tables import runs

CELL = ["extractor", "engine", "scenario"]


def put(folder, **files):
    for name, text in files.items():
        path = folder.joinpath(*name.split("__"))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def made_by_hand(tmp_path):
    root = tmp_path / "log of runs"
    one, two = root / "1", root / "two"
    put(one, **{"meta.yaml": "artifact_location: x\nexperiment_id: '1'\nlifecycle_stage: active\nname: 'it''s one: full'\n"})
    put(two, **{"meta.yaml": "name: second\nlifecycle_stage: active\n"})
    put(root / "3", **{"meta.yaml": "name: second\nlifecycle_stage: deleted\n"})
    put(root / "4", **{"meta.yaml": "name: without runs\n"})
    put(
        one / "r1",
        **{
            "meta.yaml": "run_id: r1\nstatus: 3\nstart_time: 1700000000123\nlifecycle_stage: active\n",
            "params__k": "5",
            "params__empty": "",
            "params__text": "two\nlines",
            "tags__run type": "full-run",
            "metrics__f1": "5 0.25 0\n9 0.75 2\n7 0.5 1\n",
            "metrics__test__recall": "5 nan 0\n",
            "artifacts__tags__no": "not a tag",
        },
    )
    put(one / "r2", **{"meta.yaml": 'status: "FAILED"\nstart_time:\nlifecycle_stage: active\n'})
    put(one / "r3", **{"meta.yaml": "status: 3\nlifecycle_stage: deleted\n", "tags__a": "b"})
    put(one / "r4", **{"tags__a": "no meta"})
    put(two / "r1", **{"meta.yaml": "status: 1\nstart_time: 5\n", "metrics__f1": "\n"})
    put(root / "3" / "r9", **{"meta.yaml": "status: 3\n"})
    return str(root)


def test_folders_made_by_hand(spark, tmp_path):
    root = made_by_hand(tmp_path)
    got = {(r.experiment, r.run_id): r for r in read_run_folders(spark, root).withColumn("ms", F.unix_millis("start_time")).collect()}
    assert set(got) == {("it's one: full", "r1"), ("it's one: full", "r2"), ("second", "r1")}
    first = got["it's one: full", "r1"]
    assert (first.status, first.ms) == ("FINISHED", 1700000000123)
    assert first.params == {"k": "5", "text": "two\nlines"} and first.tags == {"run type": "full-run"}
    assert first.metrics == {"f1": "0.75", "test/recall": "nan"}
    second = got["it's one: full", "r2"]
    assert (second.status, second.ms, second.tags, second.metrics) == ("FAILED", None, {}, {})
    assert got["second", "r1"].status == "RUNNING" and got["second", "r1"].metrics == {"f1": None}


def test_experiments_by_name(spark, tmp_path):
    root = made_by_hand(tmp_path)
    assert [r.run_id for r in read_run_folders(spark, root, ["second"]).collect()] == ["r1"]
    for names in (["none such"], ["without runs"], []):
        assert read_run_folders(spark, root, names).collect() == []
    # Other experiments' files are not even listed.
    files = read_run_folders(spark, root, ["second"]).inputFiles()
    assert files and all("/two/" in f for f in files)
    (tmp_path / "empty").mkdir()
    assert read_run_folders(spark, str(tmp_path / "empty")).collect() == []


def test_reports_are_equal_over_folders(spark, sf, tmp_path):
    """The run log of the events, written as folders and read back, gives the same cells."""
    keep = ["roc_auc", "auprc"]
    log = runs(spark, sf).withColumn("run_id", F.col("run_id").cast("string")).withColumn("start_time", F.date_trunc("millisecond", F.col("start_time").cast("timestamp")))
    log = log.withColumn("metrics", F.map_filter("metrics", lambda k, _: k.isin(keep))).cache()
    root = f"file://{tmp_path}/runs"
    assert write_run_folders(log, root) == log.count()
    assert write_run_folders(log.limit(3), root) == min(3, log.count())  # a task that runs twice
    back = read_run_folders(spark, root).cache()
    assert back.count() == log.count()

    def finished(frame):
        return sorted(map(str, R.with_cell_tags(R.finished_runs(frame)).select("run_id", *CELL).collect()))

    def cells(frame):
        return sorted(map(str, R.cells(frame, {"auroc": "roc_auc", "auprc": "auprc"}).select(*CELL, F.round("auroc", 9), F.round("auprc", 9)).collect()))

    assert finished(back) == finished(log) and cells(back) == cells(log)
    only = read_run_folders(spark, root, ["exp-a"])
    assert finished(only) == finished(log.where("experiment = 'exp-a'"))
