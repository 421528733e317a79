"""Registry of the named queries and the SQL fragments their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where plain SQL can state it, the SQL that checks it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c) -> Column:
    """Round to six digits; the sum turns a negative zero into zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


TECHNIQUE_LIST = "['union','boolean','stacked','error','time','inline','insider']"

CORPUS = f"""corpus AS (
  SELECT d.doc_id AS row_id, d.text AS full_query, coalesce(l.toxic, 0) AS label,
    CASE d.lang WHEN 'en' THEN 'a' WHEN 'de' THEN 'b' WHEN 'es' THEN 'c' ELSE 'd' END AS domain,
    d.source AS statement_type, d.doc_id % 40 AS query_template_id,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN ({TECHNIQUE_LIST})[(d.doc_id % 7) + 1] END AS attack_technique,
    CASE WHEN coalesce(l.toxic, 0) = 1 OR d.doc_id % 10 >= 6 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN d.doc_id % 2 = 0 THEN 'origin' ELSE 'shifted' END AS drift_set
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# Scores that both engines derive exactly: event values against error events, per group of users.
SCORES = """scores AS (
  SELECT event_id AS row_id, user_id % 8 AS cell, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
    value AS score FROM events)"""

# Attack scores of documents: their length, per domain.
DOC_SCORES = f"""{CORPUS}, doc_scores AS (
  SELECT row_id, domain AS cell, label, attack_technique, length(full_query) / 1000.0::DOUBLE AS score FROM corpus)"""

EXTRACTOR_LIST = "['li','cv','loginov','trace-expert','trace-claude','sbert']"
SCENARIO_LIST = "['a-a','b-b','c-c','d-d','bcd-a','acd-b','abd-c','abc-d']"

RUNS = f"""raw_runs AS (
  SELECT event_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 'exp-b' ELSE 'exp-a' END AS experiment,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS status, ts AS start_time,
    ({EXTRACTOR_LIST})[(user_id % 6) + 1] AS extractor,
    CASE event_type WHEN 'click' THEN 'ae' WHEN 'view' THEN 'ocsvm' WHEN 'signup' THEN 'lof'
      WHEN 'purchase' THEN 'ae' ELSE 'lof' END AS engine,
    ({SCENARIO_LIST})[(event_id % 8) + 1] AS scenario,
    CASE WHEN event_id % 3 = 0 THEN 'few_shot' END AS setting,
    CASE WHEN event_id % 13 <> 0 THEN 'full-run' ELSE 'smoke-run' END AS run_type,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS kk,
    CASE WHEN event_id % 11 <> 0 THEN value / (1.0 + value) END AS rate,
    CASE WHEN event_id % 11 <> 0 THEN value END AS val
  FROM events),
runs AS (
  SELECT *, right(scenario, 1) AS target, right(scenario, 1) AS domain,
    ([0, 5, 10, 50])[(kk % 4) + 1] AS k, kk % 5 AS seed FROM raw_runs),
done AS (SELECT * FROM runs WHERE status = 'FINISHED' AND run_type = 'full-run'),
cells AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extractor, engine, scenario
    ORDER BY start_time DESC, run_id DESC) AS rn FROM done) WHERE rn = 1)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilar.sources.tables import table

    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") % 8).alias("cell"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("value").alias("score"),
    )


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilar.sources.tables import corpus

    return corpus(spark, sf_dir).select(
        "row_id",
        F.col("domain").alias("cell"),
        "label",
        "attack_technique",
        (F.length("full_query") / F.lit(1000.0)).alias("score"),
    )
