"""One registered query per operator, on whole tables with the operators' production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vigilar.llm.contamination import REPORT_SQL as CONTAMINATION_SQL
from vigilar.llm.contamination import contamination_report
from vigilar.llm.images import QUERY_STEP, find_image_copies, pictures
from vigilar.llm.line_runs import REPORT_SQL, line_report
from vigilar.llm.main_text import extract_main_text
from vigilar.llm.mixing import mix_sources
from vigilar.llm.near_duplicates import GROUPS_SQL, near_duplicate_groups
from vigilar.llm.periodic_runs import run_report
from vigilar.llm.prefix_trie import REPORT_SQL as TRIE_SQL
from vigilar.llm.prefix_trie import trie_report
from vigilar.llm.pseudonyms import pseudonymise_documents
from vigilar.llm.quality import classify
from vigilar.llm.quality_rules import rule_report
from vigilar.llm.shards import assign_shards
from vigilar.llm.substrings import REPEATED_SQL, remove_repeated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(_table(spark, sf_dir, "documents")).drop("removed")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched for all pictures whose id is divisible by 100, among all pictures."""
    images = pictures(_table(spark, sf_dir, "embeddings"))
    return find_image_copies(images, F.col("image_id") % QUERY_STEP == 0)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a key of this query; tables of any worth need a secret one."""
    return pseudonymise_documents(_table(spark, sf_dir, "documents"), b"op6 on test tables")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(_table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_suffix_array_dedup,
        op3_image_copies,
        op4_minhash_near_dedup,
        op5_decontamination,
        op6_pseudonyms,
        op7_line_dedup,
        op8_main_text,
        op9_source_mixing,
        op10_sharding,
        op11_prefix_trie,
        op12_quality_rules,
        op13_periodic_runs,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": REPEATED_SQL,
    "op4_minhash_near_dedup": GROUPS_SQL,
    "op5_decontamination": CONTAMINATION_SQL,
    "op7_line_dedup": REPORT_SQL,
    "op11_prefix_trie": TRIE_SQL,
}
