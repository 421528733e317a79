import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilar.operators import sampling as S
from vigilar.sources import scenarios as SC
from vigilar.sources import sinks

HEADER = "full_query,label,split,attack_technique,drift_set"
ROWS = [
    '"SELECT 1",0,train,,origin',
    '"SELECT ""a"", b\nFROM t",0,train,,origin',
    '"SELECT 2",0,test,,origin',
    '"1 OR 1=1",1,test,tautology,origin',
    '"SELECT 3",0,test,,shifted',
    '"2 OR 2=2",1,test,tautology,shifted',
    ',0,train,,origin',
]


@pytest.fixture
def scenario_root(tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    (tmp_path / "a-a.csv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    return str(tmp_path)


def test_split_reader(spark, scenario_root):
    train = SC.read_scenario(spark, scenario_root, "multi", "a-a", "train", ("full_query", "label"))
    assert train.count() == 2
    assert dict(train.dtypes)["label"] == "int"
    assert 'SELECT "a", b\nFROM t' in [r.full_query for r in train.collect()]
    test = SC.read_scenario(spark, scenario_root, "multi", "a-a", "test", ("full_query", "label", "attack_technique"))
    assert {(r.label, r.attack_technique) for r in test.collect()} == {(0, None), (1, "tautology")}


def test_drift_partitions_do_not_overlap(spark, scenario_root):
    rows = SC.read_scenario(spark, scenario_root, "drift", "a", columns=("full_query", "label", "split", "drift_set", "attack_technique"))
    got = {r.part: r["count"] for r in SC.drift_partitions(rows).groupBy("part").count().collect()}
    assert got == {"origin_train": 2, "origin_test": 2, "shifted_test": 2}


def test_fewshot_file_is_the_in_domain_one(spark, scenario_root):
    assert SC.FAMILIES["fewshot"].file_name("a") == "a-a.csv"
    assert SC.lodo("b") == "acd-b"
    assert SC.read_scenario(spark, scenario_root, "fewshot", "a", "test", ("full_query", "label")).count() == 4


def test_missing_columns_and_names(spark, scenario_root):
    with pytest.raises(ValueError):
        SC.read_labelled(spark, f"{scenario_root}/a.csv", ("nope",))
    with pytest.raises(ValueError):
        SC.read_scenario(spark, scenario_root, "nope", "a")
    with pytest.raises(ValueError):
        SC.FAMILIES["multi"].file_name("zz")


def test_limits(spark, scenario_root):
    assert SC.read_whole_sample(spark, f"{scenario_root}/a.csv", limit=3).count() == 3
    assert SC.read_labelled(spark, f"{scenario_root}/a.csv", limit=4).count() == 4


def test_file_checks(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("good", "size", "hash", "free"):
        (folder / f"{name}.bin").write_bytes(b"abc")
    sha = hashlib.sha256(b"abc").hexdigest()
    files = {
        "good.bin": {"kind": "x", "bytes": 3, "sha256": sha},
        "size.bin": {"kind": "x", "bytes": 999, "sha256": "0" * 64},
        "hash.bin": {"kind": "x", "bytes": 3, "sha256": "0" * 64},
        "free.bin": {"kind": "x"},
        "gone.bin": {"kind": "x", "bytes": 3, "md5": "0" * 32},
    }
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"groups": {"main": {"files": files}}}, indent=1))
    got = SC.verify_files(SC.manifest_entries(spark, str(path)), str(folder)).collect()
    assert {r.file.split(".")[0]: r.status for r in got} == {
        "good": "ok", "size": "bad_size", "hash": "bad_hash", "free": "unchecked", "gone": "missing",
    }


@pytest.mark.parametrize(("split", "kind"), [("3000b", "md5"), ("128m", "sha256")])
def test_files_are_hashed_in_pieces(spark, tmp_path, split, kind):
    """Any bytes, in one split and in many, as the whole file gives them; no task has a file's content as one value."""
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 20_000).astype(np.uint8).tobytes()
    bom = b"\xef\xbb\xbf"
    cases = {
        "noise": noise, "line": b"a", "ended": b"a\n", "breaks": b"\n" * 3000, "returns": b"\r\n\r" * 2000, "zeros": bytes(5000), "only mark": bom,
        "mark": bom + noise, "mark ended": bom + b"a\n", "marks": bom * 2 + b"\n", "50% é [1].bin": noise[:3000] + b"\n", "packed.gz": gzip.compress(noise), "not packed.gz": noise,
    }
    folder = tmp_path / "a b"
    (folder / "below").mkdir(parents=True)
    for name, content in cases.items():
        (folder / "below" / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        files = {r["path"]: r["file"] for r in SC.files_below(spark, str(folder)).collect()}
        got = {files[r["path"]]: r["digest"] for r in SC.file_digests(spark, str(folder), list(files), kind).collect()}
        assert got == {f"below/{n}": hashlib.new(kind, c).hexdigest() for n, c in cases.items()}
        plain = [p for p in files if not p.endswith("gz")]
        plan = SC.file_digests(spark, str(folder), plain)._jdf.queryExecution().optimizedPlan().toString()
        assert "line" in plan and all("length" in p for p in plan.split("Filter")[1:] if "content" in p)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def corpus(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.lit("q").alias("full_query")
    )


def test_stratified_cap_keeps_shares_and_ignores_partitioning(spark):
    df = corpus(spark)
    a = S.stratified_cap(df, 101, 5)
    b = S.stratified_cap(df.repartition(3), 101, 5)
    assert {r.label: r["count"] for r in a.groupBy("label").count().collect()} == {0: 91, 1: 10}
    assert sorted(a.collect()) == sorted(b.collect())
    assert S.stratified_cap(df, None) is df and S.stratified_cap(df, 400).count() == 400


def test_samples_of_copies(spark):
    """A third of the rows are copies with one id; sizes stay exact."""
    copies = spark.range(100).select(F.lit(-1).cast("long").alias("row_id"), F.lit(0).alias("label"))
    df = spark.range(200).select(F.col("id").alias("row_id"), F.lit(0).alias("label")).unionByName(copies)
    for n in (1, 50, 150, 299):
        assert S.sample_n(df, n).count() == n and S.stratified_cap(df, n).count() == n


def test_prefix_samples_are_nested(spark):
    got = S.prefix_samples(corpus(spark).where("label = 0"), [0, 5, 50, 1000], [0, 1]).collect()
    ids = lambda k, s: [r.row_id for r in sorted(got, key=lambda r: r.place) if (r.k, r.seed) == (k, s)]
    for seed in (0, 1):
        assert len(ids(5, seed)) == 5 and ids(50, seed)[:5] == ids(5, seed) and ids(1000, seed)[:50] == ids(50, seed)
        assert len(ids(1000, seed)) == 360
    assert ids(5, 0) != ids(5, 1)


def test_val_share_never_overlaps_fit(spark):
    roles = S.fit_val_roles(corpus(spark, 5000)).groupBy("role").count().collect()
    sizes = {r.role: r["count"] for r in roles}
    assert sizes["fit"] + sizes["val"] == 5000 and 400 < sizes["val"] < 600


def test_resume_after_failure(spark, tmp_path):
    df = corpus(spark, 20)
    path = str(tmp_path / "out")
    calls = []

    def flaky(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return part

    with pytest.raises(RuntimeError):
        sinks.resumable_append(df, flaky, path, steps=4)
    done = spark.read.parquet(path).count()
    assert 0 < done < 20
    out = sinks.resumable_append(df, lambda p: p, path, steps=4)
    assert sorted(r.row_id for r in out.collect()) == list(range(20))


def test_feature_store(spark, tmp_path):
    store = sinks.FeatureStore(str(tmp_path))
    df = corpus(spark, 30)
    calls = []

    def compute(rows):
        calls.append(1)
        return rows.withColumn("f", F.col("row_id") * 2)

    store.features(df, compute, "x", {"a": 1})
    assert store.features(df, compute, "x", {"a": 1}).count() == 30
    assert len(calls) == 1
    store.features(df, compute, "x", {"a": 2})
    store.features(df, compute, "x", {"a": 1}, state="other")
    store.features(df.where("row_id > 0"), compute, "x", {"a": 1})
    assert len(calls) == 4
    # Other traces and other labels under the same texts: the first are computed, the second are the caller's own.
    traced = df.withColumn("depth", F.lit(1)).withColumn("label", F.lit(0))
    store.features(traced, compute, "t", inputs=["full_query", "depth"])
    store.features(traced.withColumn("depth", F.lit(2)), compute, "t", inputs=["full_query", "depth"])
    assert len(calls) == 6
    relabelled = store.features(traced.withColumn("label", F.lit(1)), compute, "t", inputs=["full_query", "depth"])
    assert len(calls) == 6 and {r.label for r in relabelled.collect()} == {1}
    words = [spark.createDataFrame([(w,)], "word string") for w in ("A", "B")]
    assert store.key(df, "k", {"keywords": words[0]}) != store.key(df, "k", {"keywords": words[1]})


def test_fingerprints_of_any_ids(spark):
    from vigilar.operators.fingerprint import table_fingerprint

    rows = [(-5, "a"), (7, None), (-(1 << 63), ""), ((1 << 63) - 1, "b"), (0, "c")]
    make = lambda rows: [r.fingerprint for r in table_fingerprint(spark.createDataFrame(rows, "row_id long, full_query string")).collect()]
    assert len(make(rows)) == 1 and make(rows) == make(rows[::-1])
    assert make(rows) != make([(7, "") if r[0] == 7 else r for r in rows])
    assert make(rows) != make([(1, "a") if r[0] == -5 else r for r in rows])  # another order


def test_file_to_detector(spark, tmp_path):
    """The README example: a scenario file, its split, a detector and its evaluation."""
    from vigilar.plans import protocols as P

    lines = ["full_query,label,split,attack_technique"]
    lines += [f"SELECT name FROM users WHERE id = {i % 7},0,{'train' if i < 90 else 'test'}," for i in range(120)]
    lines += [f"x' OR 1=1 UNION SELECT {i} -- ;,1,test,union" for i in range(20)]
    (tmp_path / "a-a.csv").write_text("\n".join(lines))
    columns = ("full_query", "label", "split", "attack_technique")
    train = SC.read_scenario(spark, str(tmp_path), "multi", "a-a", "train", columns)
    test = SC.read_scenario(spark, str(tmp_path), "multi", "a-a", "test", columns)
    assert train.select("row_id").distinct().count() == train.count() == 90
    row = P.evaluate_detector(P.train_detector(train, "ocsvm", "li"), test).first()
    assert row.roc_auc >= 0.9 and row.n_samples == 50
    table = SC.convert_csv(spark, str(tmp_path / "a-a.csv"), str(tmp_path / "table"))
    assert table.count() == 140 and table.select("row_id").distinct().count() == 140
    again = SC.read_labelled(spark, str(tmp_path / "table"))
    assert {r.row_id for r in again.collect()} == {r.row_id for r in table.collect()}


def test_draws_for_different_purposes_are_independent(spark):
    """A cap, a fraction and the calibration split of the same rows with the same seed: shares within three standard errors."""
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    chains = {
        "cap": S.stratified_cap(rows, 4000, 7),
        "sample": S.sample_n(rows, 4000, 7),
        "fraction": S.sample_fraction(rows, 0.2, 7),
        "cap of fraction": S.stratified_cap(S.sample_fraction(rows, 0.5, 7), 4000, 7),
        "budget": S.prefix_samples(rows, [4000], [7]).select("row_id", "label"),
    }
    for name, drawn in chains.items():
        n = drawn.count()
        val = S.fit_val_roles(drawn, 0.1, 7).where("role = 'val'").count()
        assert abs(val - 0.1 * n) <= 3 * (n * 0.09) ** 0.5, (name, n, val)
        fifth = 0 if name == "fraction" else S.sample_fraction(drawn, 0.2, 7).count()
        assert "fraction" in name or abs(fifth - 0.2 * n) <= 3 * (n * 0.16) ** 0.5, (name, n, fifth)


def write_csv(path, n, newline="\n"):
    """Fields with line breaks, doubled quotes, commas and empty ones; some records are longer than a split."""
    import csv

    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["full_query", "label", "split", "note"])
        for i in range(n):
            text = f"select {i} from t" + ("\n where a = 'x'\n  and b = \"y\"\n" if i % 3 == 0 else "") + ("\n" + "long line of a text\n" * 400 if i % 41 == 7 else "") + ("ü, \"q\"" if i % 5 == 0 else "")
            out.writerow([text, str(i % 2), "train" if i % 4 else "test", "" if i % 7 == 0 else f'"{i}"' if i % 11 == 0 else "\n" if i % 13 == 0 else f"n{i}"])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_parallel_csv_equals_the_reader_of_one_task(spark, tmp_path, newline):
    """Splits of 2 KB cut records in the middle of fields; ids do not depend on them."""
    from vigilar.sources.csv_scan import csv_records, read_csv

    path = str(tmp_path / "a.csv")
    write_csv(path, 600, newline)
    names = ["full_query", "label", "split", "note"]
    want = sorted(map(tuple, spark.read.options(header=True, multiLine=True, escape='"').csv(path).select(*names).collect()), key=str)
    assert len(want) == 600
    seen = {}
    for size in ("2k", "20k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            rows = read_csv(spark, path)
            tasks = csv_records(spark, path).rdd.getNumPartitions()
            got = rows.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((tuple(r[c] for c in names) for r in got), key=str) == want
        seen[size] = {r["row_id"]: r["full_query"] for r in got}
        assert len(seen[size]) == 600 and (size != "2k" or tasks > 20)
    assert seen["2k"] == seen["20k"] == seen["128m"]


def test_ids_of_many_files_and_empty_lines(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(4):
        write_csv(str(folder / f"part-{k}.csv"), 50)
    with open(folder / "part-9.csv", "w") as f:
        f.write("full_query,label,split,note\n\nselect 1,0,train,x\n\n\"two\nlines\",1,test,\n")
    rows = SC.read_labelled(spark, str(folder))
    assert rows.count() == 202 and rows.select("row_id").distinct().count() == 202
    last = sorted((r.row_id & ((1 << 40) - 1), r.full_query, r.note) for r in rows.where(F.col("row_id") >= 4 << 40).collect())
    assert last == [(2, "select 1", "x"), (4, "two\nlines", None)]
    a = {r.row_id for r in SC.read_labelled(spark, str(folder), limit=80, seed=3).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert {r.row_id for r in SC.read_labelled(spark, str(folder), limit=80, seed=3).collect()} == a
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_converted_scenarios_are_found_by_name_and_checked(spark, tmp_path):
    import hashlib

    root = str(tmp_path)
    write_csv(f"{root}/a-a.csv", 90)
    data = open(f"{root}/a-a.csv", "rb").read()
    entry = lambda sha: spark.createDataFrame([("main", "a-a.csv", len(data), sha, None)], "grp string, file string, bytes long, sha256 string, md5 string")
    good, bad = entry(hashlib.sha256(data).hexdigest()), entry("0" * 64)
    columns = ("full_query", "label")
    plain = SC.read_scenario(spark, root, "multi", "a-a", "train", columns, manifest=good)
    with pytest.raises(ValueError):
        SC.read_scenario(spark, root, "multi", "a-a", "train", columns, manifest=bad)
    want = {(r.row_id, r.full_query) for r in plain.collect()}
    with pytest.raises(ValueError):
        SC.convert_scenario(spark, root, "multi", "a-a", bad)
    SC.convert_scenario(spark, root, "multi", "a-a", good)
    assert SC.scenario_path(spark, root, "multi", "a-a").endswith("a-a.parquet")
    assert {(r.row_id, r.full_query) for r in SC.read_scenario(spark, root, "multi", "a-a", "train", columns).collect()} == want
    assert SC.read_scenario(spark, root, "multi", "a-a", "train", columns, limit=10).count() == 10
    spark.range(5).selectExpr("cast(id as string) as full_query", "0 as label", "'train' as split").write.parquet(f"{root}/b-b.parquet")
    with pytest.raises(ValueError):
        SC.read_scenario(spark, root, "multi", "b-b", "train", columns, limit=3)
