"""The few-shot query featurises its rows once, not again for every domain and step."""

import pytest

from vigilar.plans import protocols as P
from vigilar.workload import QUERIES


def test_features_are_read_back(spark, sf, monkeypatch):
    seen = []

    def stop(rows, *_):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        raise LookupError

    monkeypatch.setattr(P, "train_detector", stop)
    with pytest.raises(LookupError):
        QUERIES["fsl_results"](spark, sf)
    assert seen and not any("regexp_replace" in plan for plan in seen)


@pytest.mark.parametrize("name, step", [("suite_results", "build_scenarios"), ("drift_results", "drift_partitions"), ("model_roundtrip", "DetectorEstimator.fit")])
def test_features_of_other_grids_are_read_back(spark, sf, monkeypatch, name, step):
    seen = []

    def stop(*args):
        seen.append(args[-1]._jdf.queryExecution().optimizedPlan().toString())
        raise LookupError

    monkeypatch.setattr(f"vigilar.workload.learned.{step}", stop)
    with pytest.raises(LookupError):
        QUERIES[name](spark, sf)
    assert "features_li" in seen[0] and "regexp_replace" not in seen[0]
