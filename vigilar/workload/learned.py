"""Detectors, protocols and the stream, over the given tables."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilar.functions import lexical
from vigilar.functions.models import ModelHook
from vigilar.operators import metrics as M
from vigilar.operators import scaling
from vigilar.operators.autoencoder import AeConfig, AeModel, new_weights
from vigilar.operators.forest import ForestIndex, recall
from vigilar.operators.knn import FitIndex, collapse_copies
from vigilar.operators.lof import LofModel, lof_scores
from vigilar.operators.ocsvm import OcsvmModel
from vigilar.operators.sampling import fit_val_roles
from vigilar.plans import protocols as P
from vigilar.plans.detector import Detector, DetectorEstimator
from vigilar.plans.extractors import build_extractor
from vigilar.session import scratch_dir, stable
from vigilar.sources.scenarios import build_scenarios, drift_partitions, fewshot_sets, lodo
from vigilar.sources.tables import corpus, table_stream, traces, vectors
from vigilar.streaming.scorer import score_stream, start_scoring
from vigilar.streaming.thresholds import start_thresholds
from vigilar.workload.common import CORPUS, query, r6, rounded
from vigilar.workload.features import DOCS, li_sql
from vigilar.workload.relational import md5_of

def lof_ctes(fit: str, test: str, dist: str, k: int = 20, digits: int = 6) -> str:
    """LOF in SQL over ``fit(id, v)`` and ``test(id, v)``."""
    return f"""ff AS (SELECT a.id AS q, b.id AS s, {dist} AS d FROM {fit} a, {fit} b WHERE a.id <> b.id),
  fn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, s) AS r FROM ff) WHERE r <= {k}),
  kd AS (SELECT q AS s, max(d) AS kdist FROM fn GROUP BY q),
  lr AS (SELECT q AS s, 1.0 / (sum(greatest(kdist, d)) / {k}.0 + 1e-10) AS lrd FROM fn JOIN kd USING (s) GROUP BY q),
  tf AS (SELECT a.id AS q, b.id AS s, {dist} AS d FROM {test} a, {fit} b),
  tn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, s) AS r FROM tf) WHERE r <= {k}),
  lof AS (SELECT q AS id, round((sum(lrd) / {k}.0) / (1.0 / (sum(greatest(kdist, d)) / {k}.0 + 1e-10)) - 1.5, {digits}) AS score
    FROM tn JOIN kd USING (s) JOIN lr USING (s) GROUP BY q)"""


_VECTORS = """emb AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label, label = 9 OR vec_id % 10 >= 6 AS is_test FROM embeddings),
  fit AS (SELECT id, v FROM emb WHERE NOT is_test), test AS (SELECT id, v FROM emb WHERE is_test)"""


@query(
    "lof_scores",
    f"WITH {_VECTORS}, {lof_ctes('fit', 'test', 'list_distance(a.v, b.v)')} SELECT id AS row_id, score FROM lof",
)
def lof_query(spark, sf):
    rows = vectors(spark, sf)
    return rounded(lof_scores(rows.where(F.col("role") == "fit"), rows.where(F.col("role") == "test")), "score")


@query("knn_forest_recall", "SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def knn_forest_recall(spark, sf):
    """Approximate search against the exact one: rows with an id divisible by 100 among all rows; at least 0.9 must be found."""
    rows = vectors(spark, sf).select("row_id", "features")
    distinct = stable(collapse_copies(rows))
    queries = rows.where(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("q_id"), F.col("features").alias("vec"))
    found = ForestIndex(distinct, 20, leaf_rows=256, least_recall=0.9).neighbours(queries)
    exact = FitIndex(distinct, 20).neighbours(queries)
    return recall(found, exact).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


def _li_cte() -> str:
    inner = li_sql(DOCS)
    cols = ", ".join(f"{c}::DOUBLE" for c in lexical.LI_FEATURES)
    return f"li AS (SELECT row_id, [{cols}] AS f FROM ({inner}))"


_Z = f"""{CORPUS}, {_li_cte()},
  base AS (SELECT c.row_id AS id, c.label, c.split, c.domain, c.attack_technique, li.f,
    CASE WHEN c.label = 0 AND c.split = 'train' THEN CASE WHEN {md5_of("split", 7, "c.row_id")} < '19999999' THEN 'val' ELSE 'fit' END
      ELSE 'test' END AS role FROM corpus c JOIN li ON c.row_id = li.row_id),
  st AS (SELECT i, avg(f[i]) AS m, stddev_pop(f[i]) AS sd FROM base, range(1, 33) t(i) WHERE role = 'fit' GROUP BY i),
  stl AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN sd = 0 THEN 1.0 ELSE sd END ORDER BY i) AS sd FROM st),
  z AS (SELECT id, label, domain, attack_technique, role, list_transform(range(1, 33), lambda i: (f[i] - m[i]) / sd[i]) AS v FROM base, stl),
  fit AS (SELECT id, v FROM z WHERE role = 'fit'), test AS (SELECT id, v FROM z WHERE role <> 'fit')"""

_FLAGSHIP = f"""WITH {_Z}, {lof_ctes("fit", "test", "list_distance(a.v, b.v)")},
  thr AS (SELECT quantile_cont(score, 0.9) AS threshold FROM lof JOIN z USING (id) WHERE role = 'val'),
  low AS (SELECT domain, min(score) AS low FROM lof JOIN z USING (id) WHERE role = 'test' GROUP BY domain),
  s AS (SELECT z.domain, z.label, CASE WHEN attack_technique = 'insider' THEN low ELSE score END AS score
    FROM lof JOIN z USING (id) JOIN low ON low.domain = z.domain WHERE role = 'test'),
  bs AS (SELECT domain, score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM s GROUP BY domain, score),
  steps AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY domain) AS pos, sum(n) OVER (PARTITION BY domain) AS neg
    FROM bs WINDOW w AS (PARTITION BY domain ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT domain, max(pos)::BIGINT AS n_attacks, (max(pos) + max(neg))::BIGINT AS n_test, round(max(threshold), 4) AS threshold,
  round(sum(n * (tp - p / 2)) / nullif(max(pos) * max(neg), 0), 4) AS auroc,
  coalesce(sum(p) FILTER (score > threshold), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (score > threshold), 0)::BIGINT AS fp
FROM steps, thr GROUP BY domain"""


@query("flagship", _FLAGSHIP)
def flagship(spark, sf):
    """Corpus, lexical features, z-score, exact LOF, threshold at 10 % false positives, metrics per domain."""
    rows = fit_val_roles(corpus(spark, sf), 0.1, 7)
    train = (F.col("label") == 0) & (F.col("split") == "train")
    rows = rows.withColumn("role", F.when(train, F.col("role")).otherwise("test"))
    feats = stable(lexical.li_vector(rows).drop("full_query"))
    scaler = scaling.fit_scaler(feats.where(F.col("role") == "fit"), "standard")
    scaled = feats.withColumn("features", scaler.apply("features"))
    model = LofModel.fit(scaled.where(F.col("role") == "fit"))
    unseen = scaled.where(F.col("role") != "fit")
    scored = stable(
        rounded(model.score(unseen), "score").join(unseen.select("row_id", "domain", "label", "attack_technique", "role"), "row_id")
    )
    thr = M.percentile_threshold(scored.where(F.col("role") == "val"), 0.1)
    test = M.mask_insider(scored.where(F.col("role") == "test"), ["domain"])
    thresholds = test.select("domain").distinct().withColumn("threshold", F.lit(thr.first()["threshold"]))
    out = M.evaluate(test, thresholds, ["domain"])
    return out.select(
        "domain", "n_attacks", "n_test", F.round("threshold", 4).alias("threshold"), F.round("auroc", 4).alias("auroc"), "tp", "fp"
    )


@query("ocsvm_rff_scores")
def ocsvm_rff_scores(spark, sf):
    rows = vectors(spark, sf)
    model = OcsvmModel.fit(rows.where(F.col("role") == "fit"), 64)
    return rounded(model.score(rows.where(F.col("role") == "test"), ("row_id", "label")), "score")


def _ae_model(spark, sf) -> tuple[DataFrame, AeModel]:
    rows = vectors(spark, sf)
    return rows, AeModel.fit(rows.where(F.col("role") == "fit"), 64, AeConfig(output="tanh"))


@query("ae_scores")
def ae_scores(spark, sf):
    rows, model = _ae_model(spark, sf)
    return rounded(model.score(rows.where(F.col("role") == "test"), ("row_id", "label")), "score")


@query("ae_worker_invariance", "SELECT p AS partitions, 0.0::DOUBLE AS diff FROM (VALUES (1), (4), (8)) t(p)")
def ae_worker_invariance(spark, sf):
    """Largest difference of weights between fits of differently partitioned rows, with several groups."""
    fit = vectors(spark, sf).where(F.col("role") == "fit")
    config = AeConfig(epochs=10, batch_size=4, output="tanh")
    made = [AeModel.fit(fit.repartition(p), 64, config).weights for p in (1, 4, 8)]
    gaps = [max(float(np.abs(a - b).max()) for a, b in zip(made[0], w, strict=True)) for w in made]
    return spark.createDataFrame(list(zip((1, 4, 8), gaps, strict=True)), "partitions int, diff double")


@query("ae_finetune_scores")
def ae_finetune_scores(spark, sf):
    rows, model = _ae_model(spark, sf)
    benign = rows.where((F.col("role") == "test") & (F.col("label") == 0))
    tuned = model.fine_tune(benign, learning_rate=5e-4)
    return rounded(tuned.score(rows.where(F.col("role") == "test"), ("row_id", "label")), "score")


def _layer_sql(src: str, dst: str, w: np.ndarray, b: np.ndarray, act: str) -> str:
    rows = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in col) + "]" for col in w.T) + "]"
    bias = "[" + ", ".join(repr(float(x)) for x in b) + "]"
    z = f"list_dot_product(({rows}::DOUBLE[][])[j], v) + ({bias}::DOUBLE[])[j]"
    f = {"relu": f"greatest({z}, 0.0)", "tanh": f"tanh({z})"}[act]
    return f"{dst} AS (SELECT row_id, x, list_transform(range(1, {len(b) + 1}), lambda j: {f}) AS v FROM {src})"


def _fixed_weight_sql() -> str:
    w = new_weights(64, 3)
    layers, src = [], "l0"
    for i in range(4):
        layers.append(_layer_sql(src, f"l{i + 1}", w[2 * i], w[2 * i + 1], "tanh" if i == 3 else "relu"))
        src = f"l{i + 1}"
    return f"""WITH l0 AS (SELECT vec_id AS row_id, list_transform(embedding, lambda t: t::DOUBLE) AS x,
      list_transform(embedding, lambda t: t::DOUBLE) AS v FROM embeddings), {", ".join(layers)}
    SELECT row_id, round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - x[i]) * (v[i] - x[i]))) / 64.0, 4) AS score FROM l4"""


@query("ae_scores_fixed_weights", _fixed_weight_sql())
def ae_scores_fixed_weights(spark, sf):
    """Forward pass of given weights over every embedding."""
    rows = vectors(spark, sf).select("row_id", "features")
    model = AeModel(new_weights(64, 3), AeConfig(output="tanh"))
    return model.score(rows).withColumn("score", F.round("score", 4))


def _li_rows(spark, sf) -> DataFrame:
    """The corpus with lexical features in place of its texts, computed once and read back by all that follows."""
    return stable(P.add_features(corpus(spark, sf), ["li"]).drop("full_query"))


@query("suite_results")
def suite_results(spark, sf):
    """All in-domain and held-out scenarios with every head, at the protocol's rates and full training."""
    scen = stable(build_scenarios(_li_rows(spark, sf)))
    names = ["a-a", "b-b", "c-c", "d-d", "bcd-a", "acd-b", "abd-c", "abc-d"]
    return P.suite_results(*P.suite_scores(scen, P.grid(["ocsvm", "lof", "ae"], ["li"], names)), dataset="multi")


@query("drift_results")
def drift_results(spark, sf):
    """Origin and shifted test rows of every domain."""
    cells = ((_li_rows(spark, sf), ("lof", "li")), (corpus(spark, sf), ("ocsvm", "tfidf")))  # word counts need the texts
    scored = [P.drift_scores(drift_partitions(rows), [cell], ["a", "b", "c", "d"]) for rows, cell in cells]
    return P.drift_results(*[a.unionByName(b) for a, b in zip(*scored, strict=True)], dataset="drift")


@query("fsl_results")
def fsl_results(spark, sf):
    """Adaptation of the held-out model of every domain, for all budgets and seeds, on its whole test set.

    Rows are featurised once for all domains, which run side by side, as the small jobs of one leave the cluster idle.
    """
    rows = _li_rows(spark, sf)

    def adapted(target: str) -> DataFrame:
        base = P.train_detector(rows.where((F.col("domain") != target) & (F.col("split") == "train")), "ae", "li")
        train, test = fewshot_sets(rows, target)
        return P.fewshot_results(base, train, test, target=target, source=lodo(target), dataset="fewshot")

    with ThreadPoolExecutor(4) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(adapted, "abcd")))


class WordLengthModel:
    """A model small enough to be written down in SQL as well: a token is a word, its state (length, place, 1)."""

    def tokens(self, text):
        return [len(w) for w in re.findall(r"[^ \t\n\r\f\v]+", text)]

    def states(self, ids, mask):
        return np.stack([ids, np.cumsum(mask, axis=1) - 1, np.ones_like(ids)], axis=2)

    def vectors(self, ids, mask):
        return (self.states(ids, mask) * mask[:, :, None]).sum(axis=1)


_WORDS = r"list_filter(string_split_regex(full_query, '[ \t\n\r\f\v]+'), lambda w: w <> '')[:512]"


@query(
    "model_hook_vectors",
    f"""WITH {CORPUS}, w AS (SELECT row_id, list_transform({_WORDS}, lambda x: length(x)::DOUBLE) AS ls FROM corpus),
    v AS (SELECT row_id, len(ls) AS n, coalesce(list_sum(ls), 0.0) AS total, len(ls) * (len(ls) - 1) / 2.0 AS places, coalesce(ls[1], 0.0) AS head FROM w)
    SELECT row_id, 'sbert' AS extractor, total AS a, places AS b, n::DOUBLE AS c FROM v
    UNION ALL SELECT row_id, 'qwen3-emb', round(total / z, 6), round(places / z, 6), round(n / z, 6)
      FROM (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE sqrt(total * total + places * places + n * n) END AS z FROM v)
    UNION ALL SELECT row_id, 'modernbert', head, 0.0, (n > 0)::INT::DOUBLE FROM v
    UNION ALL SELECT row_id, 'flan-t5', round(total / greatest(n, 1), 6), round(places / greatest(n, 1), 6), (n > 0)::INT::DOUBLE FROM v""",
)
def model_hook_vectors(spark, sf):
    """A caller's model behind four entries of different pooling, over all texts."""
    rows, hook, out = corpus(spark, sf).select("row_id", "full_query"), ModelHook("word-length", WordLengthModel), None
    for name in ("sbert", "qwen3-emb", "modernbert", "flan-t5"):
        made = build_extractor(name, model=hook).transform(rows)
        one = made.select("row_id", F.lit(name).alias("extractor"), *[F.round(F.col("features")[i], 6).alias(c) for i, c in enumerate("abc")])
        out = one if out is None else out.unionByName(one)
    return out


@query("simple_evaluate")
def simple_evaluate(spark, sf):
    rows = corpus(spark, sf)
    det = P.train_detector(rows.where(F.col("split") == "train"), "lof", "tfidf")
    return P.evaluate_detector(det, rows.where(F.col("split") == "test"))


@query("trace_detector_scores")
def trace_detector_scores(spark, sf):
    """Trace features with the one-class SVM; rows without a trace stand out."""
    rows = traces(spark, sf).withColumn("label", F.col("semantic_tree").isNull().cast("int"))
    det = P.train_detector(rows, "ocsvm", "trace-expert", None)
    return rounded(det.score(rows, ("row_id", "label")), "score")


@query(
    "model_roundtrip",
    f"""WITH {CORPUS} SELECT method, count(*) AS n, 0.0::DOUBLE AS diff FROM corpus, (VALUES ('ae'), ('lof'), ('ocsvm')) m(method)
    WHERE split = 'test' GROUP BY method""",
)
def model_roundtrip(spark, sf):
    """Largest score difference between a detector and its saved and reloaded copy."""
    rows = _li_rows(spark, sf)
    test = rows.where(F.col("split") == "test")
    out = None
    for method, config in (("ae", AeConfig(epochs=10)), ("lof", None), ("ocsvm", None)):
        model = DetectorEstimator(method, "li", config).fit(rows.where(F.col("split") == "train"))
        path = f"{scratch_dir(spark, 'model')}/{method}"
        model.save(path)
        again = Detector.load(path).score(test).withColumnRenamed("score", "again")
        both = model.detector.score(test).join(again, "row_id")
        one = both.agg(
            F.lit(method).alias("method"), F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(F.col("score") - F.col("again")))).alias("diff")
        )
        out = one if out is None else out.unionByName(one)
    return out


def _stream(spark, sf):
    """The documents table as a stream of query rows."""
    return table_stream(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("full_query"))


@query("stream_scores", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, 0::BIGINT AS n_odd FROM documents")
def stream_scores(spark, sf):
    """Stateless scoring stream with a calibrated threshold, drained into a table."""
    rows = corpus(spark, sf).where((F.col("label") == 0) & (F.col("split") == "train"))
    det, val, _ = P.fit_and_score(rows, rows, "ae", "li", ("row_id",))[:3]
    threshold = M.percentile_threshold(val, 0.1).first()["threshold"]
    out = scratch_dir(spark, "stream")
    scored = score_stream(_stream(spark, sf), det, threshold)
    job = scored.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c")
    job.trigger(availableNow=True).start().awaitTermination()
    odd = F.col("score").isNull() | F.isnan("score") | (F.col("alert") != (F.col("score") > F.lit(threshold)).cast("int"))
    return spark.read.parquet(f"{out}/t").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), F.count_if(odd).alias("n_odd")
    )


@query("stream_scores_lof")
def stream_scores_lof(spark, sf):
    """Neighbour-search scoring of micro-batches against the static fit table."""
    rows = corpus(spark, sf).where((F.col("label") == 0) & (F.col("split") == "train"))
    det = P.train_detector(rows, "lof", "li")
    out = scratch_dir(spark, "stream")
    start_scoring(_stream(spark, sf), det, 0.5, f"{out}/t", f"{out}/c").awaitTermination()
    return spark.read.parquet(f"{out}/t").select("row_id", "score", "alert")


@query(
    "stream_running_thresholds",
    """WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents WHERE lang IS NOT NULL)
    SELECT lang, count(*) AS n, count(*) FILTER (place > 30) AS n_judged, 0::BIGINT AS n_odd FROM r GROUP BY lang""",
)
def stream_running_thresholds(spark, sf):
    """A stateful stream: the share of symbols of a document against the running quantile of its language."""
    source = table_stream(spark, sf, "documents")
    share = F.regexp_count("text", F.lit(r"[^\p{L}\s]")) / F.greatest(F.length("text"), F.lit(1))
    scored = source.select("lang", "doc_id", F.coalesce(share, F.lit(0.0)).alias("score"))
    out = scratch_dir(spark, "stream")
    start_thresholds(scored, f"{out}/t", f"{out}/c", "lang", "doc_id", 0.01, 30).awaitTermination()
    odd = F.col("alert") != F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).cast("int")
    return spark.read.parquet(f"{out}/t").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("threshold").alias("n_judged"), F.count_if(odd).alias("n_odd"))
