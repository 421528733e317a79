"""A caller's model behind all embedding entries: batched equals one by one, loaded once, prepared texts, empty input."""

import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vigilar.functions.models import ModelHook, drop_words
from vigilar.functions.pooling import DOC_MAX_TOKENS, MAX_TOKENS
from vigilar.plans.detector import Detector
from vigilar.plans.extractors import EXTRACTORS, build_extractor

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module
ENTRIES = [n for n, e in EXTRACTORS.items() if e.pretrained]


class Stub:
    """States depend on a token, its place and its left neighbour; batches must not be wider than they need."""

    def tokens(self, text):
        return [1 + (len(w) * 31 + ord(w[0])) % 997 for w in re.findall(r"\S+", text)]

    def states(self, ids, mask):
        assert (mask.sum(axis=1).max() == ids.shape[1]) or ids.shape[1] == 1
        place = np.cumsum(mask, axis=1)
        before = np.where(place > 1, np.roll(ids, 1, axis=1), 0)
        return np.stack([np.sin(ids * (k + 1.0)) + np.cos(place * 0.1 * k) + before / 500 for k in range(6)], axis=2)

    def vectors(self, ids, mask):
        return np.tanh((self.states(ids, mask) * mask[:, :, None]).sum(axis=1) * 0.01)


TEXTS = [" ".join(f"w{(i * j) % 17}{'x' * (j % 5)}" for j in range((i * 37) % 700)) for i in range(40)] + ["", "one", "  two words \n", None]


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "row_id long, full_query string").repartition(3)


def alone(model, pool, text):
    text = text or ""
    if pool == "suffix":
        body = drop_words(text, model).rstrip() + " [/INST]"
        ids, n = model.tokens("[INST] " + body)[:MAX_TOKENS], len(model.tokens(body))
    else:
        ids, n = model.tokens(text)[:MAX_TOKENS], 0
    if not ids:
        return np.zeros(6)
    ids = np.array([ids])
    states, vector = model.states(ids, np.ones_like(ids))[0], model.vectors(ids, np.ones_like(ids))[0]
    return {"none": vector, "l2": vector / np.linalg.norm(vector), "first": states[0], "mean": states.mean(0), "suffix": states[-n:].mean(0) if n else states.mean(0)}[pool]


@pytest.mark.parametrize("name", ENTRIES)
def test_batched_equals_one_by_one(spark, name):
    made = build_extractor(name, model=ModelHook("stub", Stub, batch_size=8))
    pool = made.pool
    got = {r.row_id: r.features for r in made.fit(frame(spark)).transform(frame(spark)).collect()}
    assert made.dim == 6 and len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        np.testing.assert_allclose(got[i], alone(Stub(), pool, text), atol=1e-12)
    assert made.transform(frame(spark).limit(0)).collect() == []


def test_ten_entries():
    assert len(ENTRIES) == 10 and {build_extractor(n).pool for n in ENTRIES} == {"none", "first", "mean", "l2", "suffix"}


def test_words_are_dropped_in_rounds():
    model = Stub()
    for n in (10, 400, 401, 500, 900, 5000):
        kept, words = n, n
        while min(MAX_TOKENS, words) > DOC_MAX_TOKENS:
            words = int(words * (DOC_MAX_TOKENS / min(MAX_TOKENS, words)))
        text = drop_words(" ".join(["w"] * n), model)
        assert len(text.split()) == words <= max(kept, DOC_MAX_TOKENS)


class Counting(Stub):
    def __init__(self, folder):
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()


def test_the_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)
    made = build_extractor("sbert", model=ModelHook(f"counting-{folder}", lambda: Counting(folder)))
    made.transform(frame(spark).repartition(24)).select(F.sum(F.size("features"))).collect()
    loaded = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert loaded and len(loaded) == len(set(loaded))


def test_detector_with_a_model_is_saved_and_loaded(spark, tmp_path):
    rows = frame(spark).withColumn("label", F.lit(0))
    hook = ModelHook("stub", Stub)
    det = Detector("lof", "sentbert", model=hook).fit(rows)
    det.save(str(tmp_path / "m"), spark)
    again = Detector.load(str(tmp_path / "m"), spark, model=hook)
    a, b = ({r.row_id: r.score for r in d.score(rows).collect()} for d in (det, again))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
