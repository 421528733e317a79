"""The pattern that cuts tokens without a step back gives those of the pattern stated in SQL."""

from pyspark.sql import functions as F

from vigilar.functions import roles

ODD = [
    "", "select a.b as c , t.x(1, 2) desc,z from t", "0x1F, 0x 0xg 12.5, 12. 3 as d, 7asc", "'a','b' as q, 'open", "f(x) asc ascii, b desc, desc",
    "*, * as é, **,*/ /* a */ /* open", "-- c\n# d\r\n\"x\" `y` \"open `", "a  \t\n, b\r, c , d ,e", "a.b.c(d)(e), x as  y z, x as 1,", "<=> <> != || && ~ € \x00 ² ½a _$1,",
]


def tokens_by(df, pattern):
    return [r.t for r in df.select("row_id", F.regexp_extract_all("full_query", F.lit(pattern), F.lit(0)).alias("t")).orderBy("row_id").collect()]


def test_both_patterns_cut_alike(spark):
    df = spark.createDataFrame(list(enumerate(ODD + [x.replace(" ", "") for x in ODD])), "row_id long, full_query string")
    assert tokens_by(df, roles.JAVA_TOKEN_PATTERN) == tokens_by(df, roles.TOKEN_PATTERN)


def test_long_dotted_names_do_not_overflow(spark):
    df = spark.createDataFrame([(1, "a" + ".b" * 8_000 + " c")], "row_id long, full_query string")
    assert roles.tagged_tokens(df).select(F.size("tagged")).first()[0] == 16_002


def test_listed_marks_are_words_of_the_caller(spark):
    df = spark.createDataFrame([(1, "a + ; =")], "row_id long, full_query string")
    tagged = roles.tagged_tokens(df, keywords=["A", "+"]).first()["tagged"]
    assert [t["role"] for t in tagged] == ["Keyw", "Identifi", "Punct"]
