"""SQL keyword lists.

Features that need "is this a keyword" take the list as a parameter: any iterable of
words, or a DataFrame with a ``word`` column (for example a copy of MySQL's
``information_schema.keywords``). ``engine_keywords`` reads Spark's own list;
``CORE_KEYWORDS`` is a short default.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Common reserved words and functions of SQL.
CORE_KEYWORDS = (
    "ADD", "ALL", "ALTER", "AND", "AS", "ASC", "AVG", "BETWEEN", "BY", "CASE", "CAST",
    "CHECK", "COALESCE", "COLUMN", "CONCAT", "CONVERT", "COUNT", "CREATE", "CROSS",
    "DATABASE", "DEFAULT", "DELETE", "DESC", "DISTINCT", "DROP", "ELSE", "END", "EXISTS",
    "FALSE", "FOR", "FROM", "FULL", "GRANT", "GROUP", "HAVING", "IF", "IN", "INDEX",
    "INNER", "INSERT", "INTO", "IS", "JOIN", "KEY", "LEFT", "LENGTH", "LIKE", "LIMIT",
    "LOWER", "MAX", "MIN", "MOD", "NOT", "NULL", "OFFSET", "ON", "OR", "ORDER", "OUTER",
    "PRIMARY", "REPLACE", "REVOKE", "RIGHT", "SELECT", "SET", "SHOW", "SLEEP", "SUBSTR",
    "SUBSTRING", "SUM", "TABLE", "THEN", "TO", "TRUE", "UNION", "UNIQUE", "UPDATE",
    "UPPER", "USER", "USING", "VALUES", "VERSION", "VIEW", "WHEN", "WHERE", "WITH", "XOR",
)

MAX_KEYWORDS = 10_000


def engine_keywords(spark: SparkSession) -> tuple[str, ...]:
    """The keywords of Spark SQL itself."""
    return keyword_list(spark.sql("SELECT keyword AS word FROM sql_keywords()"))


def keyword_list(words: Iterable[str] | DataFrame) -> tuple[str, ...]:
    """Upper-cased, sorted, distinct words; a list is small by nature and checked to be."""
    if isinstance(words, DataFrame):
        rows = words.select("word").limit(MAX_KEYWORDS + 1).collect()
        if len(rows) > MAX_KEYWORDS:
            raise ValueError(f"more than {MAX_KEYWORDS} keywords")
        words = [r["word"] for r in rows]
    return tuple(sorted({w.upper() for w in words if w}))
