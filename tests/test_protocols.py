"""The protocol queries compute every cell of their grids."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from vigilar.operators.autoencoder import AeConfig
from vigilar.plans import protocols as P
from vigilar.plans.detector import Detector, NoFitRowsError


def test_suite(rows_of_query):
    out = rows_of_query("suite_results")
    cells = set(product(["a-a", "b-b", "c-c", "d-d", "bcd-a", "acd-b", "abd-c", "abc-d"], ["ocsvm", "lof", "ae"], ["li"]))
    assert set(zip(out["scenario"], out["method"], out["extractor"], strict=True)) == cells and len(out) == len(cells)
    assert list(out.columns) == P.SUITE_COLUMNS and set(out["kind"]) == {"in_domain", "lodo"}
    assert (out["n_train"] > 0).all() and (out["fit_seconds"] > 0).all() and out["recall_per_attack"].str.startswith("{").all()


def test_drift(rows_of_query):
    out = rows_of_query("drift_results")
    cells = set(product("abcd", [("lof", "li"), ("ocsvm", "tfidf")]))
    assert {(r.domain, (r.method, r.extractor)) for r in out.itertuples()} == cells and len(out) == len(cells)
    assert list(out.columns) == [*P.DRIFT_COLUMNS, "recall_per_attack_s1", "recall_per_attack_s2"]


def test_fewshot(rows_of_query):
    out = rows_of_query("fsl_results")
    cells = set(product("abcd", [0], P.SEEDS[:1])) | set(product("abcd", [k for k in P.KS if k], P.SEEDS))
    assert set(zip(out["target"], out["k"], out["seed"], strict=True)) == cells and len(out) == len(cells)
    assert list(out.columns) == P.FEWSHOT_COLUMNS and set(out["lodo_source"]) == {"bcd-a", "acd-b", "abd-c", "abc-d"}


def rows_of(spark, n_train, technique="insider"):
    rows = [("s", "train", i, f"select {i} from t{i % 3}", 0, None) for i in range(n_train)]
    rows += [("s", "test", 1000 + i, f"select {i} from t{i % 3}", 0, None) for i in range(40)]
    rows += [("s", "test", 2000 + i, f"x' or {i} = {i} union select null, null -- #", 1, technique if i % 2 else "union") for i in range(20)]
    return spark.createDataFrame(rows, "scenario string, split string, row_id long, full_query string, label int, attack_technique string")


def test_cells_without_rows_to_fit_have_null_metrics(spark):
    with pytest.raises(NoFitRowsError):
        Detector("lof", "li").fit(rows_of(spark, 0).where("split = 'train'"))
    scored = P.suite_scores(rows_of(spark, 0), [("s", "lof", "li"), ("s", "ae", "li")])
    out = P.suite_results(*scored).collect()
    assert len(out) == 2 and all(r.n_train == 0 and r.n_test == 60 and r.n_attacks == 20 and r.roc_auc is None and r.threshold is None for r in out)


def test_capture_insider_and_curves(spark, tmp_path):
    """Insider attacks are forced to the lowest score unless the caller says that they are seen."""
    rows, cells, configs = rows_of(spark, 120), [("s", "ae", "li")], {"ae": AeConfig(epochs=20, batch_size=64)}
    recall = {}
    for seen in (False, True):
        scored = P.suite_scores(rows, cells, configs=configs, capture_insider=seen, save_to=str(tmp_path / f"m{seen}"))
        row = P.suite_results(*scored, target_fpr=0.05).first()
        recall[seen] = row.recall_per_attack
        assert row.model_path.endswith("s_ae_li") and Detector.load(row.model_path, spark).score(rows).count() == 180
    assert '"insider":0.0' in recall[False] and '"insider":0.0' not in recall[True]
    P.write_curves(scored[0], str(tmp_path / "curves"))
    assert spark.read.parquet(str(tmp_path / "curves" / "roc")).where("scenario = 's'").agg(F.max("tpr")).first()[0] == 1.0


def test_kind_comes_from_the_manifest(spark):
    scored = P.suite_scores(rows_of(spark, 60), [("s", "lof", "li")])
    manifest = spark.createDataFrame([("main", "s.csv", "special")], "grp string, file string, kind string")
    assert P.suite_results(*scored, manifest=manifest).first().kind == "special"


def test_evaluation_scores_rows_once(spark):
    """All metrics of a table read the same scores; a search for neighbours is not run for each."""
    scored = spark.sparkContext.accumulator(0)

    class Counted:
        def score(self, rows, keep):
            def count(batches):
                for pdf in batches:
                    scored.add(len(pdf))
                    yield pdf

            return rows.mapInPandas(count, rows.schema)

    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("label"), (F.col("id") * 1.0).alias("score"))
    got = P.evaluate_detector(Counted(), rows).collect()
    assert [(r.n_samples, r.n_attacks) for r in got] == [(40, 10)] and scored.value == 40
