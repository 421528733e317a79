"""Semantic roles of SQL tokens and the three text views built from them (``kakisim``).

A lexical tagger: one alternation regex cuts the text into tokens, and expressions give
every token its role. Grammar trees are not built; comma-separated lists are recognised
by the same regex.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilar.functions.chars import SPACE
from vigilar.functions.keywords import CORE_KEYWORDS, keyword_list
from vigilar.functions.tokens import words

# Words with a role of their own.
ROLE_WORDS = {
    "DCL": ("GRANT", "REVOKE"),
    "CTE": ("WITH",),
    "Where": ("WHERE",),
    "Order": ("ASC", "DESC"),
    "Builtin": (
        "DATE", "TIME", "TIMESTAMP", "VARCHAR", "CHAR", "INT", "INTEGER", "UNSIGNED", "BINARY",
    ),
    "Func": (
        "SLEEP", "BENCHMARK", "SUBSTRING", "SUBSTR", "MID", "LENGTH", "LEN", "COUNT", "SUM",
        "AVG", "MAX", "MIN", "UPPER", "LOWER", "CONCAT", "GROUP_CONCAT", "COALESCE", "IFNULL",
        "IF", "CAST", "CONVERT", "CHAR_LENGTH", "LOAD_FILE", "VERSION", "DATABASE", "USER",
        "CURRENT_USER", "SCHEMA", "HEX", "UNHEX", "ASCII", "ORD", "FLOOR", "CEILING", "RAND",
        "EXTRACTVALUE", "UPDATEXML",
    ),
    "DLL": ("CREATE", "ALTER", "DROP", "TRUNCATE"),
    "DML": ("SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE", "UPSERT", "COMMIT", "ROLLBACK", "START"),
}
# Marks with a role of their own.
ROLE_MARKS = {
    "Par": ("(", ")"),
    "Escap": ("'", "--", "#"),
    "Wildcard": ("*",),
    "Comparison": ("<=>", "<=", ">=", "<>", "!=", "=", "<", ">"),
    "Oper": ("||", "&&", "+", "-", "/", "%", "&", "|", "^", "~", "!", ":", "@"),
    "Punct": (",", ";", ".", "[", "]", "{", "}"),
}
# Roles whose token text is left out of a view.
NOISY_T = ("Int",)
NOISY_E = ("Int", "Punct", "Par")

_NAME = r"[\p{L}_][\p{L}\p{N}_$]*"
_ITEM = rf"(?:'[^']*'|[0-9]+(?:\.[0-9]+)?|{_NAME}(?:\.{_NAME})*(?:\([^()]*\))?|\*)(?:[ \t\n]+(?:[aA][sS][ \t\n]+{_NAME}|[aA][sS][cC]|[dD][eE][sS][cC]))?"
# An element of a comma list together with its comma. Lists are joined token by token, as a
# regex that repeats a group over a long list would overflow the matcher's stack.
ELEMENT_PATTERN = rf"{_ITEM}[ \t\n]*,"
# Order matters: the first alternative that matches wins.
TOKEN_PATTERN = "|".join(
    (
        ELEMENT_PATTERN,
        r"--[^\n]*",
        r"#[^\n]*",
        r"(?s:/\*.*?\*/)",
        r"'[^']*'",
        r'"[^"]*"',
        r"`[^`]*`",
        r"0[xX][0-9a-fA-F]+",
        r"[0-9]+(?:\.[0-9]+)?",
        _NAME,
        r"<=>|<=|>=|<>|!=|=|<|>",
        r"\|\||&&|[+\-/%&|^~!:@]",
        r"\*",
        r"[(),;.\[\]{}]",
        rf"[^\p{{L}}\p{{N}}{SPACE}]",
    )
)


def _java_pattern() -> str:
    """The same tokens without a step back: what follows a run never begins with one of its characters, so runs are possessive.

    White space fails at once, and an element of a list and the same token without its comma are one alternative.
    """
    name = rf"{_NAME}+"
    words = rf"(?:[ \t\n]++(?:[aA][sS][ \t\n]++{name}|[aA][sS][cC]|[dD][eE][sS][cC]))?+[ \t\n]*+,"
    alternatives = (
        rf"{name}(?:(?:\.{name})*+(?:\([^()]*+\))?+{words})?+",
        r"0[xX][0-9a-fA-F]++",
        rf"[0-9]++(?:\.[0-9]++)?+(?:{words})?+",
        rf"'[^']*+'(?:{words})?+",
        r"--[^\n]*+",
        r"#[^\n]*+",
        r"(?s:/\*.*?\*/)",
        r'"[^"]*+"',
        r"`[^`]*+`",
        r"<=>|<=|>=|<>|!=|=|<|>",
        r"\|\||&&|[+\-/%&|^~!:@]",
        rf"\*(?:{words})?+",
        r"[(),;.\[\]{}]",
        rf"[^\p{{L}}\p{{N}}{SPACE}]",
    )
    return rf"(?![ \t\n\r])(?:{'|'.join(alternatives)})"


JAVA_TOKEN_PATTERN = _java_pattern()


def sql_tokens(text: str | Column) -> Column:
    """Tokens of the first statement, in order."""
    c = F.col(text) if isinstance(text, str) else text
    tokens = F.regexp_extract_all(c.cast("string"), F.lit(JAVA_TOKEN_PATTERN), F.lit(0))
    end = F.array_position(tokens, F.lit(";"))
    return F.when(end > 0, F.slice(tokens, 1, end.cast("int"))).otherwise(tokens)


def _role(token: Column, following: Column, keywords: tuple[str, ...]) -> Column:
    up = F.upper(token)
    reserved = F.when(up.isin(*ROLE_WORDS["DML"]), "DML")
    for name, members in ROLE_WORDS.items():
        reserved = reserved.when(up.isin(*members), name)
    known = sorted({*keywords, *(w for members in ROLE_WORDS.values() for w in members)})
    # One hash lookup settles marks and most words; the finer cases follow only on a hit.
    marks = {name: [m for m in members if m not in known] for name, members in ROLE_MARKS.items()}
    mark = F.when(token.isin(*marks["Punct"]), "Punct") if marks["Punct"] else F.when(F.lit(False), "Punct")
    for name, members in marks.items():
        mark = mark.when(token.isin(*members), name) if members and name != "Punct" else mark
    role = F.when(token.isin(*(m for members in marks.values() for m in members)), mark)
    role = role.when(up.isin(*known), reserved.otherwise(F.when(token.rlike(rf"^{_NAME}+$"), "Keyw").otherwise("Identifi")))
    role = role.when(token.rlike(rf"^{_NAME}+$"), F.when(following == "(", "Func").otherwise("Identifi"))
    role = role.when(token.rlike(r"^[0-9]++(\.[0-9]++)?$"), "Int")
    role = role.when(token.rlike(r"^0[xX][0-9a-fA-F]++$"), "Hexadecimal")
    role = role.when(token.rlike(r"^'[^']*+'$"), "Quot").when(token.rlike(r'^("[^"]*+"|`[^`]*+`)$'), "Identifi")
    role = role.when(token.rlike(r"^(--|#|/\*)"), "Escap")
    # What is left is either one odd character or a compound element such as ``t.col``.
    return role.otherwise(F.when(F.length(token) > 1, "Identifi").otherwise("Error"))


def _is_element(token: Column) -> Column:
    return token.endswith(",") & (F.length(token) > 1)


def _can_end_list(token: Column) -> Column:
    return token.rlike(rf"^('[^']*'|[0-9]+(\.[0-9]+)?|{_NAME}|\*)$")


def tagged_tokens(
    df: DataFrame, text: str = "full_query", keywords: Iterable[str] | DataFrame = CORE_KEYWORDS, out: str = "tagged"
) -> DataFrame:
    """Append ``ARRAY<STRUCT<value, role>>``.

    The first element of a comma list carries the role ``Identifierlist``; the other
    elements follow with a NULL role, so a list counts once among the roles.
    """
    listed = keyword_list(keywords)
    # Tokens travel with their neighbours, so that the lambda refers to nothing outside it: a
    # predicate on the result may then be pushed down without re-tokenising per element.
    tok = F.col("_tok")
    blank = F.array(F.lit(""))
    n = F.size(tok)
    zipped = F.arrays_zip(
        tok.alias("t"),
        F.concat(blank, F.slice(tok, 1, F.greatest(n - 1, F.lit(0)))).alias("before"),
        F.concat(F.slice(tok, 2, F.greatest(n - 1, F.lit(0))), blank).alias("after"),
    )

    def entry(value: Column, role: Column) -> Column:
        return F.struct(value.alias("value"), role.cast("string").alias("role"))

    def tag(z: Column) -> Column:
        t, before, after = z["t"], z["before"], z["after"]
        bare = F.regexp_replace(t, r"[ \t\n]*,$", "")
        continues = _is_element(after) | _can_end_list(after)
        follows = _is_element(before)
        comma = entry(F.lit(","), F.lit("Punct"))
        element = (
            F.when(follows & continues, F.array(entry(bare, F.lit(None))))
            .when(follows, F.array(entry(bare, F.lit(None)), comma))
            .when(continues, F.array(entry(bare, F.lit("Identifierlist"))))
            .otherwise(F.array(entry(bare, _role(bare, F.lit(","), listed)), comma))
        )
        last = F.array(entry(t, F.lit(None)))
        single = F.array(entry(t, _role(t, after, listed)))
        return F.when(_is_element(t), element).when(follows & _can_end_list(t), last).otherwise(single)

    with_tokens = df.withColumn("_tok", sql_tokens(text)).withColumn("_zip", F.when(n > 0, zipped))
    tagged = F.coalesce(F.flatten(F.transform("_zip", tag)), F.array().cast("array<struct<value:string,role:string>>"))
    return with_tokens.withColumn(out, tagged).drop("_tok", "_zip")


def view_texts(df: DataFrame, tagged: str = "tagged") -> DataFrame:
    """Append the views ``T`` (values without numbers), ``C`` (roles) and ``E`` (roles and values)."""
    col = F.col(tagged)
    t = F.transform(F.filter(col, lambda x: F.coalesce(~x["role"].isin(*NOISY_T), F.lit(True))), lambda x: x["value"])
    c = F.transform(F.filter(col, lambda x: x["role"].isNotNull()), lambda x: x["role"])
    e = F.transform(
        col, lambda x: F.when(x["role"].isin(*NOISY_E), x["role"]).otherwise(F.concat_ws(" ", x["role"], x["value"]))
    )
    return df.select(
        "*",
        F.array_join(t, " ").alias("T"),
        F.array_join(c, " ").alias("C"),
        F.array_join(e, " ").alias("E"),
    )


def view_term_counts(
    df: DataFrame,
    views: Iterable[str] = ("T", "C", "E"),
    text: str = "full_query",
    keywords: Iterable[str] | DataFrame = CORE_KEYWORDS,
    row_id: str = "row_id",
) -> DataFrame:
    """Long counts per view: (row_id, view, term, n)."""
    viewed = view_texts(tagged_tokens(df.select(row_id, text), text, keywords))
    views = list(views)
    texts = F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("txt")) for v in views])
    one = viewed.select(row_id, F.explode_outer(texts).alias("v")).select(row_id, "v.view", "v.txt")
    terms = one.select(row_id, "view", F.explode_outer(words("txt")).alias("term"))
    return terms.where(F.col("term").isNotNull()).groupBy(row_id, "view", "term").agg(F.count(F.lit(1)).alias("n"))


def view_vocabulary(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """Learned terms per view that occur in at least ``min_df`` texts."""
    vocab = counts.groupBy("view", "term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    return vocab.where(F.col("df") >= min_df)
