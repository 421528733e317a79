"""Token-class counts with learned punctuation (``loginov``), bag of words and TF-IDF."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilar.functions.chars import SPACE, WORD
from vigilar.functions.keywords import CORE_KEYWORDS, keyword_list
from vigilar.session import small_side, stable

# The output columns, in order.
LOGINOV_FEATURES = (
    "n_anomalous_schars",
    "s1_n_keywords",
    "s1_n_alpha",
    "s1_n_numeric",
    "s1_n_mixed",
    "s2_n_keywords",
    "s2_n_alpha",
    "s2_n_numeric",
    "s2_n_mixed",
)

SPECIAL_RUN = f"[^a-zA-Z0-9{SPACE}]+"
DEFAULT_TFIDF_FEATURES = 200


def special_runs(text: str | Column) -> Column:
    """All maximal runs of characters that are neither ASCII alphanumeric nor white space."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(c.cast("string"), F.lit(SPECIAL_RUN), F.lit(0))


def learn_special_runs(fit: DataFrame, text: str = "full_query") -> DataFrame:
    """Distinct runs seen in the training texts (column ``run``)."""
    per_text = fit.select(F.explode_outer(F.array_distinct(special_runs(text))).alias("run"))
    return per_text.where(F.col("run").isNotNull()).distinct()


def _unknown_runs(known: list[str]):
    """Arrow function: how many entries of each list are not among ``known``."""

    @F.arrow_udf("int")
    def count(runs: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(runs), 0))
        fresh = ~np.asarray(pc.is_in(pc.list_flatten(runs), value_set=pa.array(known, pa.string())).to_numpy(zero_copy_only=False))
        total = np.concatenate([[0], np.cumsum(fresh)])
        ends = np.cumsum(sizes)
        return pa.array((total[ends] - total[ends - sizes]).astype(np.int32))

    return count


def _class_counts(tokens: Column, keywords: tuple[str, ...], prefix: str) -> dict[str, Column]:
    """Counts of keyword / alphabetic / numeric / mixed among ASCII alphanumeric tokens."""
    is_kw = lambda t: F.upper(t).isin(*keywords)
    alpha = F.filter(tokens, lambda t: t.rlike("^[a-zA-Z]+$"))
    n_kw_all = F.size(F.filter(tokens, is_kw))
    n_kw_alpha = F.size(F.filter(alpha, is_kw))
    numeric = F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))
    n_kw_num = F.size(F.filter(numeric, is_kw))
    n_alpha = F.size(alpha) - n_kw_alpha
    n_num = F.size(numeric) - n_kw_num
    return {
        f"{prefix}_n_keywords": n_kw_all,
        f"{prefix}_n_alpha": n_alpha,
        f"{prefix}_n_numeric": n_num,
        f"{prefix}_n_mixed": F.size(tokens) - n_kw_all - n_alpha - n_num,
    }


def loginov_columns(
    df: DataFrame,
    valid_runs: DataFrame,
    text: str = "full_query",
    keywords: Iterable[str] | DataFrame = CORE_KEYWORDS,
) -> DataFrame:
    """Append the nine columns of :data:`LOGINOV_FEATURES` (INT) to ``df``.

    ``valid_runs`` comes from :func:`learn_special_runs`. A run not in it counts as
    anomalous, every time it occurs.
    """
    words = tuple(w for w in keyword_list(keywords) if w.isascii() and w.isalnum())
    raw = F.col(text).cast("string")
    s1 = F.regexp_extract_all(raw, F.lit("[a-zA-Z0-9]+"), F.lit(0))
    s2_text = F.regexp_replace(raw, f"[^a-zA-Z0-9{SPACE}+]+", "")
    s2 = F.regexp_extract_all(s2_text, F.lit("[a-zA-Z0-9]+"), F.lit(0))
    prepared = df.withColumn("_runs", special_runs(text)).withColumn("_s1", s1).withColumn("_s2", s2)
    counts = {**_class_counts(F.col("_s1"), words, "s1"), **_class_counts(F.col("_s2"), words, "s2")}

    # The learned runs go along with the tasks as one sorted value set, on streams as well.
    known = sorted(r["run"] for r in valid_runs.toLocalIterator())
    counts["n_anomalous_schars"] = _unknown_runs(known)(F.coalesce("_runs", F.array().cast("array<string>")))
    return prepared.select(*df.columns, *[counts[n].cast("int").alias(n) for n in LOGINOV_FEATURES])


# ---- bag of words ---------------------------------------------------------------


def words(text: str | Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c.cast("string")), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def term_counts(df: DataFrame, text: str | Column = "full_query", row_id: str = "row_id") -> DataFrame:
    """Long bag of words: one row (row_id, term, n) per distinct term of a text.

    A text's words are in one row, so they are sorted and counted there: nothing moves. The outer
    explode keeps Spark from adding a non-empty filter that would match the regex a second time.
    """
    rows = df.select(row_id, F.sort_array(words(text)).alias("_words"))
    starts = F.filter(F.transform("_words", lambda x, i: F.when((i == 0) | (x != F.get("_words", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.select(row_id, "_words", starts.alias("_starts"))
    exploded = rows.select(row_id, "_words", "_starts", F.posexplode_outer("_starts").alias("_j", "_at")).where(F.col("_at").isNotNull())
    end = F.coalesce(F.get("_starts", F.col("_j") + 1), F.size("_words"))
    return exploded.select(row_id, F.get("_words", F.col("_at")).alias("term"), (end - F.col("_at")).cast("long").alias("n"))


def vocabulary(counts: DataFrame, max_features: int | None = None) -> DataFrame:
    """Terms of the training counts with corpus frequency ``tf`` and document frequency ``df``.

    With a cap, the terms most frequent over the corpus stay (ties: alphabetical).
    """
    vocab = counts.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        vocab = vocab.orderBy(F.col("tf").desc(), "term").limit(max_features)
    return vocab


TERM_BUCKETS = 1 << 20


def top_terms(counts: DataFrame, k: int, buckets: int = TERM_BUCKETS) -> DataFrame:
    """The ``k`` terms most frequent over the corpus (ties: alphabetical), exactly, with (term, tf, df).

    ``vocabulary`` with a cap for vocabularies too large to be shuffled: rare terms never move. Counts per
    hash bucket, which add up from anywhere, bound the count of each of their terms from above. The
    terms of the fullest ``2 k`` buckets are counted: the k-th of them bounds the k-th of all from
    below. Then only terms of buckets that reach this are counted. The counts are read three times,
    so for vocabularies that fit a shuffle ``vocabulary`` is faster.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket")
    keyed = counts.select("term", "n", bucket)
    totals = stable(keyed.groupBy("bucket").agg(F.sum("n").alias("total")))  # at most ``buckets`` rows
    head = F.broadcast(totals.orderBy(F.desc("total"), "bucket").limit(2 * k).select("bucket"))
    seen = keyed.join(head, "bucket", "leftsemi").groupBy("term").agg(F.sum("n").alias("tf")).orderBy(F.desc("tf")).limit(k)
    low = seen.agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
    least = low["tf"] if low["n"] == k else 0
    wide = F.broadcast(totals.where(F.col("total") >= least).select("bucket"))  # eight bytes a bucket
    exact = keyed.join(wide, "bucket", "leftsemi").groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    return exact.orderBy(F.desc("tf"), "term").limit(k)


def tfidf(
    counts: DataFrame, vocab: DataFrame, n_docs: int, row_id: str = "row_id"
) -> DataFrame:
    """Smoothed, row-normalised TF-IDF in long form: (row_id, term, weight).

    idf = ln((1 + n) / (1 + df)) + 1, weights scaled to unit length per row.
    """
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    raw = counts.join(small_side(vocab), "term").select(row_id, "term", (F.col("n") * idf).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(row_id)))
    return raw.select(row_id, "term", (F.col("_w") / norm).alias("weight"))


def index_terms(vocab: DataFrame) -> list[str]:
    """Alphabetical list of a capped vocabulary (its size is the cap)."""
    return sorted(r["term"] for r in vocab.select("term").collect())
