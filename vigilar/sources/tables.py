"""Views over the given tables in the shapes the operators work on.

``documents`` and ``labels`` give the labelled corpus, ``pages`` a punctuation-rich one,
``embeddings`` the dense vectors, ``events`` the run log, and document words the traces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilar.functions.traces import PARSE_BYTES, byte_slices

TECHNIQUES = ("union", "boolean", "stacked", "error", "time", "inline", "insider")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    # A pattern, as a stream takes a plain path for a folder.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core, by the hash of its id.

    Text features cost CPU per byte, and a small file with few row groups would leave
    cores idle. A scan with enough splits, as any large table has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() <= cores else df


def texts(spark: SparkSession, sf_dir: str, name: str, row_id: str, text: str, *more: str) -> DataFrame:
    """A text table as (row_id column, text column, more...), spread over the cores."""
    return spread(table(spark, sf_dir, name).select(row_id, text, *more), row_id)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, full_query, label, domain, statement_type, query_template_id, attack_technique, split, drift_set)."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    label = F.coalesce("toxic", F.lit(0))
    names = F.array(*[F.lit(t) for t in TECHNIQUES])
    domain = F.when(F.col("lang") == "en", "a").when(F.col("lang") == "de", "b").when(F.col("lang") == "es", "c")
    return docs.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("full_query"),
        label.alias("label"),
        domain.otherwise("d").alias("domain"),
        F.col("source").alias("statement_type"),
        (F.col("doc_id") % 40).alias("query_template_id"),
        F.when(label == 1, F.get(names, (F.col("doc_id") % 7).cast("int"))).alias("attack_technique"),
        F.when((label == 1) | (F.col("doc_id") % 10 >= 6), "test").otherwise("train").alias("split"),
        F.when(F.col("doc_id") % 2 == 0, "origin").otherwise("shifted").alias("drift_set"),
    )


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages", "page_id", "html")
    return pages.select(F.col("page_id").alias("row_id"), F.col("html").alias("full_query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, features ARRAY<DOUBLE>, label, role): label 9 is the attack class, seen in test only."""
    emb = table(spark, sf_dir, "embeddings")
    attack = F.col("label") == 9
    return emb.select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        attack.cast("int").alias("label"),
        F.when(attack | (F.col("vec_id") % 10 >= 6), "test").otherwise("fit").alias("role"),
    )


# Tags used when words are turned into trace nodes; two are outside every vocabulary.
TRACE_TAGS = (
    "CREATE", "TABLE", "DELETE", "INDEX", "MODIFY", "VIEW", "EXECUTE", "USER", "READ", "DATABASE",
    "DDL_CREATE", "DML_SELECT", "EXPRESSION", "DML", "Literal", "Views", "OTHER",
)


def _node_heads(n: int) -> pa.Array:
    """What comes before the word in the first ``n`` nodes of a trace."""
    i = np.arange(n)
    tags = [pa.array(TRACE_TAGS).take(pa.array((i + shift) % len(TRACE_TAGS))) for shift in (0, 3)]
    place, kind = pa.array(i).cast(pa.string()), pa.array(830 + i % 1020).cast(pa.string())
    return pc.if_else(pa.array(i % 9 == 8), place, pc.binary_join_element_wise(place, kind, "7", *tags, ":"))


def _trees(texts: pa.Array, has: pa.Array) -> pa.Array:
    """Texts as traces, a node for every word; NULL where there is no text or ``has`` is false."""
    heads, made = _node_heads(1024), []
    for part in byte_slices(pc.if_else(has, texts, pa.scalar(None, pa.string())), PARSE_BYTES // 8):
        split = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(part, ""), r"[:|\t\r\n]", " "), " ")
        words, parents = pc.list_flatten(split), pc.list_parent_indices(split)
        filled = pc.greater(pc.binary_length(words), 0)
        words, parents = pc.filter(words, filled), pc.filter(parents, filled).to_numpy(zero_copy_only=False)
        offsets = np.searchsorted(parents, np.arange(len(part) + 1))
        place = np.arange(len(words)) - offsets[parents]
        if len(place) and place.max() >= len(heads):
            heads = _node_heads(2 * int(place.max()))
        nodes = pc.binary_join_element_wise(heads.take(pa.array(place)), words, ":")
        trees = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes), "|")
        trees = pc.binary_join_element_wise(trees, "||-||tail:x", "")
        made.append(pc.if_else(pc.is_valid(part), trees, pa.scalar(None, pa.string())))
    return pa.concat_arrays(made)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows built from all words of a document (some fields missing on purpose).

    Every tenth document has no trace; every ninth word becomes a node with too few fields.
    """
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    has = F.col("doc_id") % 10 != 0
    n = F.regexp_count("text", F.lit(r"[^:| \t\r\n]+"))
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("full_query"),
        F.arrow_udf(_trees, "string")("text", has).alias("semantic_tree"),
        F.when(has, n).alias("n_terminal"),
        F.when(has, (n / 2).cast("int")).alias("n_nonterminal"),
        F.when(has, F.lit(0)).alias("is_syntax_error"),
        F.when(has, n % 13).alias("depth"),
        F.when(has, F.lit(1)).alias("n_parser_invoc"),
    )


EXTRACTORS = ("li", "cv", "loginov", "trace-expert", "trace-claude", "sbert")
SCENARIOS = ("a-a", "b-b", "c-c", "d-d", "bcd-a", "acd-b", "abd-c", "abc-d")
K_BUDGETS = (0, 5, 10, 50)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: (run_id, experiment, status, start_time, tags MAP, params MAP, metrics MAP)."""
    e = table(spark, sf_dir, "events")
    pick = lambda values, index: F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
    engine = (
        F.when(F.col("event_type") == "click", "ae").when(F.col("event_type") == "view", "ocsvm")
        .when(F.col("event_type") == "signup", "lof").when(F.col("event_type") == "purchase", "ae").otherwise("lof")
    )
    extractor = pick(EXTRACTORS, F.col("user_id") % 6)
    scenario = pick(SCENARIOS, F.col("event_id") % 8)
    k = F.get_json_object("props", "$.k").cast("int")
    legacy = F.floor(F.col("event_id") / 8) % 2 == 0  # every scenario has runs of both spellings
    rate = F.col("value") / (F.lit(1.0) + F.col("value"))
    gone = F.col("event_id") % 11 == 0
    tags = F.map_filter(
        F.create_map(
            F.lit("feature_extractor"), extractor,
            F.lit("decision_engine"), F.when(~legacy, engine),
            F.lit("pipeline"), F.when(legacy, engine),
            F.lit("scenario"), F.when(~legacy | (F.col("event_id") % 3 == 0), scenario),
            F.lit("dataset"), F.when(legacy & (F.col("event_id") % 7 != 0), scenario),
            F.lit("target"), F.substring(scenario, -1, 1),
            F.lit("domain"), F.substring(scenario, -1, 1),
            F.lit("setting"), F.when((F.col("event_id") % 3 == 0) & ~legacy, "few_shot"),
            F.lit("kind"), F.when((F.col("event_id") % 3 == 0) & legacy, "few_shot"),
            F.lit("run_type"), F.when(F.col("event_id") % 13 != 0, "full-run").otherwise("smoke-run"),
        ),
        lambda _, v: v.isNotNull(),
    )
    num = lambda c: F.when(gone, F.lit("NaN")).otherwise(c.cast("string"))
    metrics = F.create_map(
        F.lit("roc_auc"), num(rate),
        F.lit("auroc"), num(rate),
        F.lit("auprc"), num(rate * rate),
        F.lit("auroc_ci"), num((F.lit(1.0) - rate) / 10.0),
        F.lit("auprc_ci"), num((F.lit(1.0) - rate) / 20.0),
        F.lit("precision"), num(rate * 0.9),
        F.lit("recall"), num(rate * 0.8),
        F.lit("f1"), num(rate * 0.85),
        F.lit("fpr"), num((F.lit(1.0) - rate) / 5.0),
        F.lit("auroc_s1"), num(rate),
        F.lit("auroc_s2"), num(rate * 0.95),
        F.lit("infer_ms_per_query"), num(F.col("value") / 100.0),
        F.lit("infer_median_seconds"), num(F.col("value")),
        *[x for i, t in enumerate(TECHNIQUES) for x in (F.lit(f"recall_{t}"), num(rate / (i + 1.0)))],
    )
    params = F.create_map(
        F.lit("k"), pick(K_BUDGETS, k % 4).cast("string"), F.lit("seed"), (k % 5).cast("string"),
        F.lit("scenario"), scenario, F.lit("n_test"), (F.lit(1000) + k).cast("string"),
    )
    return e.select(
        F.col("event_id").alias("run_id"),
        F.when(F.col("event_id") % 5 == 0, "exp-b").otherwise("exp-a").alias("experiment"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("FINISHED").alias("status"),
        F.col("ts").alias("start_time"),
        tags.alias("tags"),
        params.alias("params"),
        metrics.alias("metrics"),
    )
