"""Repeated runs of lines by a suffix array over line ids, in DataFrame operations only.

1. Texts become sequences of their lines that are not blank; lines that occur once cannot be part
   of a repeated run and drop out of the arrays, not out of the texts.
2. Prefix doubling: the suffixes that share their first line form classes; the class of the first
   2h lines follows from the classes of the first h lines here and h lines on. Classes are sorted
   and numbered in that order, so that numbers compare as the runs do; classes of one are left out.
3. A repeated run of at least ``MIN_WORDS`` words is a union of shortest such windows that start at
   its lines or end at them. The suffixes whose common prefix covers such a window are an interval
   of the suffix array, named by the classes of two overlapping powers of two; its earliest
   place stays, and the lines of all later ones are deleted.

All joins are on a document and line or on the classes of a run; copies only make classes larger,
and these are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilar.llm.store import saved
from vigilar.llm.words import keyed

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _numbered(pairs: DataFrame, *names: str) -> DataFrame:
    """Classes of at least two members, sorted and numbered in that order."""
    classes = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*names)
    return saved(classes.orderBy(*names).withColumn("r", F.monotonically_increasing_id()), "classes")


def _doubled(ranks: DataFrame, h: int) -> DataFrame:
    """Classes of the first 2h lines from those of the first h."""
    ahead = ranks.select("_id", "_h", (F.col("i") - h).alias("i"), F.col("r").alias("r2"))
    pairs = saved(ranks.withColumnRenamed("r", "r1").join(ahead, ["_id", "_h", "i"]), "pairs")
    return saved(pairs.join(_numbered(pairs, "r1", "r2"), ["r1", "r2"]).select("_id", "_h", "i", "r"), "ranks")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Shortest windows of at least ``min_words`` words from each line on, and up to each line: (_id, _h, i, m)."""
    of = Window.partitionBy("_id", "_h")
    # Rows of one document may be repeated; its lines are counted once. All of this is one exchange.
    lines = lines.repartition("_id", "_h").groupBy("_id", "_h", "i").agg(F.max("w").alias("w"))
    lines = lines.withColumn("c", F.sum("w").over(of.orderBy("i"))).withColumn("p", F.col("c") - F.col("w"))
    after = of.orderBy("p").rangeBetween(Window.currentRow, min_words - 1)
    before = of.orderBy("c").rangeBetween(-(min_words - 1), Window.currentRow)
    lines = lines.withColumns({
        "m1": F.count(F.lit(1)).over(after), "s1": F.sum("w").over(after),
        "m2": F.count(F.lit(1)).over(before), "s2": F.sum("w").over(before),
    })
    forth = F.struct(F.col("i").cast("int").alias("i"), F.col("m1").cast("int").alias("m"), (F.col("s1") >= min_words).alias("whole"))
    back = F.struct((F.col("i") - F.col("m2") + 1).cast("int").alias("i"), F.col("m2").cast("int").alias("m"), (F.col("s2") >= min_words).alias("whole"))
    return lines.select("_id", "_h", F.inline(F.array(forth, back))).where("whole").select("_id", "_h", "i", "m").distinct()


def _later(windows: DataFrame, ranks: DataFrame, h: int) -> DataFrame:
    """Windows of h to 2h - 1 lines whose run of lines also starts earlier."""
    head = ranks.select("_id", "_h", "i", F.col("r").alias("r1"))
    tail = ranks.select("_id", "_h", F.col("i").alias("j"), F.col("r").alias("r2"))
    own = windows.where((F.col("m") >= h) & (F.col("m") < 2 * h)).join(head, ["_id", "_h", "i"])
    own = saved(own.withColumn("j", F.col("i") + F.col("m") - h).join(tail, ["_id", "_h", "j"]).drop("j"), "runs")
    key = ["m", "r1", "r2"]
    first = own.groupBy(*key).agg(F.min(F.struct("_id", "i")).alias("first"), F.max(F.struct("_id", "i")).alias("last")).where("first < last")
    return own.join(first, key).where(F.struct("_id", "i") > F.col("first")).select("_id", "_h", "i", "m")


def repeated_line_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _h, runs) of the documents of ``keyed``: ranges (i, m) of lines that also start earlier."""
    digests = lambda line: [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")]
    lines = docs.select("_id", "_h", F.posexplode(_lines(F.col("text"))).alias("i", "line"))
    lines = saved(lines.select("_id", "_h", "i", F.regexp_count("line", F.lit(WORD)).cast("long").alias("w"), *digests(F.col("line"))), "lines")
    ranks = saved(lines.join(_numbered(lines, "a", "b"), ["a", "b"]).select("_id", "_h", "i", "r"), "ranks")
    windows = _windows(lines.select("_id", "_h", "i", "w"), min_words)
    # A window that repeats starts with a line that repeats.
    windows = saved(windows.join(ranks.select("_id", "_h", "i").distinct(), ["_id", "_h", "i"], "leftsemi"), "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0
    found, h = windows.limit(0), 1
    while h <= longest:
        found = found.unionByName(_later(windows, ranks, h))
        h *= 2
        if h <= longest:
            ranks = _doubled(ranks, h // 2)
    return saved(found.groupBy("_id", "_h").agg(F.collect_set(F.struct("i", "m")).alias("runs")), "line_runs")


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, kept_text, n_lines, n_removed and n_runs for every row of ``docs`` (doc_id, text).

    Blank lines are no lines and are not kept. Null, empty and blank texts have no lines. "Earlier"
    is a smaller doc_id, or an earlier line in the same document; a null doc_id comes last. Rows
    equal in doc_id and text are one document and give equal results. An empty table gives an
    empty result, other columns are ignored.
    """
    docs = keyed(docs)
    runs = repeated_line_runs(docs, min_words)
    # One plan at all sizes: texts are dealt once, not sorted, and the runs never broadcast.
    out = docs.join(runs.hint("shuffle_hash"), ["_id", "_h"], "left").select("doc_id", _lines(F.col("text")).alias("lines"), "runs")
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["i"], x["i"] + x["m"] - 1))))
    out = out.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    # Differences of sets of places take time in proportion to the lines, however many are removed.
    places = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(places, "gone"), lambda i: F.get("lines", i))
    starts = F.array_except("gone", F.transform("gone", lambda i: i + 1))
    return out.select(
        "doc_id",
        F.array_join(kept, "\n").alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size(starts).cast("long").alias("n_runs"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and kept_sha256 (lowercase hex) for every row."""
    return remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


# The same in plain SQL, for tables small enough for it.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), c AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l
), p AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM c
), win AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 3
), txt AS (
  SELECT win.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS body FROM win JOIN p ON p.doc_id = win.doc_id AND i BETWEEN s AND e GROUP BY 1, 2, 3
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY body ORDER BY doc_id, s) AS place FROM txt
), gone AS (
  SELECT DISTINCT p.doc_id, p.i FROM ranked r JOIN p ON p.doc_id = r.doc_id AND p.i BETWEEN s AND e WHERE place > 1
), marked AS (
  SELECT p.doc_id, p.i, p.line, g.i IS NOT NULL AS g,
         coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY p.doc_id ORDER BY p.i), false) AS before
  FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
), counted AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g) AS n_removed, count(*) FILTER (WHERE g AND NOT before) AS n_runs,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT g) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""
