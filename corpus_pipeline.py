"""From raw documents to a sharded, mixed corpus: five stages, each kept as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilar.llm.contamination import contaminated, find_contamination, hit_words
from vigilar.llm.mixing import mix_sources, whole_copies, words_of
from vigilar.llm.near_duplicates import near_duplicate_groups
from vigilar.llm.quality import classify
from vigilar.llm.shards import assign_shards
from vigilar.llm.store import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps (op 1)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (op 4): the one with the smallest doc_id."""
    groups = saved(near_duplicate_groups(docs).select("doc_id", "kept"), "groups")
    kept = groups.where("kept").select(F.col("doc_id").alias("k")).distinct()
    out = docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("k")), "leftsemi")
    # Rows that repeat a doc_id are its duplicates as well; rows without one cannot be told to be.
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.head(1):
        out = out.withColumn("_r", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", "_r"])
    return out.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (op 5)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, columns=COLUMNS)
    return found.where(~contaminated(hit_words(), F.col("n_words"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words (op 9); the words of a source stay near its target."""
    taken = saved(mix_sources(docs).select("doc_id", "source", "size", "taken"), "taken")
    key = ("doc_id", "source", "size")
    copies = whole_copies(taken).groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    copies = saved(copies, "copies")
    out = docs.withColumn("_size", words_of("text"))
    same = ("doc_id", "source", "_size")
    repeated = copies.where("_rows > 1").head(1)
    # Rows that agree in all of the key share its copies: the first of them take what is left over.
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("text"))) if repeated else F.lit(1)
    out = out.withColumn("_rank", rank)
    joined = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(same, ("_doc_id", "_source", "_size_"), strict=True)]
    out = out.join(copies.where("_copies > 0").withColumnRenamed("_size", "_size_").hint("shuffle_hash"), joined)
    times = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_rank") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return out.withColumn("_times", times.cast("int")).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot (op 10)."""
    return assign_shards(docs, columns=COLUMNS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

# The classifier and the search for near duplicates have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
