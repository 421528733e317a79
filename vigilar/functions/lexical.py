"""Hand-crafted lexical features of a query text: 32 flags and character counts (``li``).

Stateless column expressions; everything stays in the JVM and one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilar.functions.chars import SPACE, WORD, digit_class, upper_class

# The words and operators the features are defined by.
QUERY_KEYWORDS = ("select", "update", "drop", "insert", "create")
DATABASE_KEYWORDS = ("sysobjects", "msysobjects", "version", "information_schema")
CONNECTION_KEYWORDS = ("inner join", "and", "or", "xor")
FILE_KEYWORDS = ("load_file", "infile", "outfile", "dumpfile")
STRING_FUNCTIONS = ("substr", "substring", "mid", "asc")
COMPARISON_OPERATORS = ("=", "<", ">", "<=", ">=", "<>", "!=")

# The output columns, in order.
LI_FEATURES = (
    "len_query",
    "has_null",
    "has_comment",
    "has_query_keywords",
    "has_union",
    "has_database_keywords",
    "has_connection_keywords",
    "has_file_keywords",
    "has_exec",
    "has_string_functions",
    "c_comparison",
    "has_exists",
    "has_floor",
    "has_rand",
    "has_group",
    "has_order",
    "has_length",
    "has_ascii",
    "has_concat",
    "has_if",
    "has_count",
    "has_sleep",
    "has_tautology",
    "c_num",
    "c_upper",
    "c_space",
    "c_special",
    "c_arith",
    "c_square_brackets",
    "c_round_brackets",
    "has_multiline_comment",
    "c_curly_brackets",
)

# Features that test for one whole word; the word is the name after ``has_``.
WORD_FLAGS = (
    "null", "union", "exec", "exists", "floor", "rand", "group", "order",
    "length", "ascii", "concat", "if", "count", "sleep",
)


def _kept(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]++", ""))


def _times(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of ``literal``."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (gone / F.lit(len(literal))).cast("int")


def _any(text: Column, words) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def li_columns(df: DataFrame, text: str = "full_query") -> DataFrame:
    """Append the 32 columns of :data:`LI_FEATURES` (INT) to ``df``."""
    words = (*WORD_FLAGS, *QUERY_KEYWORDS, *STRING_FUNCTIONS)
    raw, rest = F.col("_raw"), F.col("_rest")
    low = F.col("_low")
    marks, odd = F.col("_marks"), F.col("_odd")
    found = F.col("_found")
    prepared = df.withColumn("_raw", F.col(text).cast("string")).withColumn("_low", F.lower("_raw"))
    # Most characters are plain ASCII. Cheap passes split the text into its ASCII punctuation,
    # its other ASCII (without lower-case letters) and its non-ASCII characters; classes that
    # need Unicode properties run on the last, usually short, part only. (Java matches a
    # negated union of ranges about ten times slower than a positive one.)
    prepared = prepared.withColumns(
        {
            "_marks": F.regexp_replace("_raw", r"[a-zA-Z0-9\s\x{1c}-\x{1f}\x{80}-\x{10ffff}]++", " "),
            "_rest": F.regexp_replace("_raw", r"[a-z!-/:-@\[-`{-~\x{80}-\x{10ffff}]++", ""),
            "_odd": F.regexp_replace("_raw", r"\p{ASCII}++", ""),
        }
    )
    prepared = prepared.withColumn(
        "_found", F.array_intersect(F.split("_low", f"[^{WORD}]++"), F.array(*[F.lit(w) for w in words]))
    )

    def has(*names: str) -> Column:
        return F.arrays_overlap(found, F.array(*[F.lit(n) for n in names])) if len(names) > 1 else F.array_contains(
            found, names[0]
        )

    special = f"{WORD.replace('_', '')}{digit_class()}{upper_class()}{SPACE}"
    flags = {
        "has_comment": F.contains(marks, F.lit("--")) | F.contains(marks, F.lit("#")),
        "has_query_keywords": has(*QUERY_KEYWORDS),
        "has_database_keywords": _any(low, DATABASE_KEYWORDS),
        "has_connection_keywords": _any(low, CONNECTION_KEYWORDS),
        "has_file_keywords": _any(low, FILE_KEYWORDS),
        "has_string_functions": has(*STRING_FUNCTIONS),
        "has_tautology": F.contains(marks, F.lit("=")) & F.regexp_like(raw, F.lit(rf"([{WORD}]+)=\1")),
        "has_multiline_comment": F.contains(marks, F.lit("/*")) | F.contains(marks, F.lit("*/")),
        **{f"has_{w}": has(w) for w in WORD_FLAGS},
    }
    slash_star, star_slash = _times(marks, "/*"), _times(marks, "*/")
    counts = {
        "len_query": F.length(raw),
        "c_comparison": sum((_times(marks, op) for op in COMPARISON_OPERATORS[1:]), _times(marks, "=")),
        "c_num": F.length(F.regexp_replace(rest, r"[A-Z\x{0}-\x{20}\x{7f}]++", "")) + _kept(odd, digit_class()),
        "c_upper": F.length(F.regexp_replace(rest, r"[0-9\x{0}-\x{20}\x{7f}]++", "")) + _kept(odd, upper_class()),
        "c_space": F.length(F.regexp_replace(rest, r"[A-Z0-9\x{0}-\x{8}\x{e}-\x{1b}\x{7f}]++", "")) + _kept(odd, SPACE),
        "c_special": F.length(F.regexp_replace(marks, r"[ /*+\-\[\](){}]++", ""))
        + F.length(F.regexp_replace(odd, f"[{special}]++", "")),
        "c_arith": F.length(F.regexp_replace(marks, r"[^+\-/*]++", "")) - slash_star - star_slash,
        "c_square_brackets": _kept(marks, r"\[\]"),
        "c_round_brackets": _kept(marks, "()"),
        "c_curly_brackets": _kept(marks, "{}"),
    }
    values = {**counts, **{k: v.cast("int") for k, v in flags.items()}}
    return prepared.select(*df.columns, *[values[name].cast("int").alias(name) for name in LI_FEATURES])


def li_vector(df: DataFrame, text: str = "full_query", out: str = "features") -> DataFrame:
    """Append the same features as one ``ARRAY<DOUBLE>``."""
    wide = li_columns(df, text)
    vector = F.array(*[F.col(n).cast("double") for n in LI_FEATURES]).alias(out)
    return wide.select(*df.columns, vector)
