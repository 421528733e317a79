import pytest
from pyspark.sql import functions as F

from vigilar.functions import lexical, pooling, roles, tokens
from vigilar.functions import traces as TR
from vigilar.functions.keywords import CORE_KEYWORDS, engine_keywords
from vigilar.plans.extractors import EXTRACTORS, build_extractor, observes_insider


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "row_id long, full_query string")


def li(spark, text):
    return lexical.li_columns(texts(spark, text)).first().asDict()


def test_registry():
    assert len(EXTRACTORS) == 22
    assert observes_insider("trace-expert") and not observes_insider("li") and not observes_insider("nope")
    with pytest.raises(ValueError):
        build_extractor("nope")


def test_li_quirks(spark):
    f = li(spark, "SELECT land FROM t WHERE a<=1 AND x1=x1 /* c */ -- é²Ⅷ")
    assert f["has_query_keywords"] == 1 and f["has_connection_keywords"] == 1
    assert f["c_comparison"] == 4  # "<=" counts as "<", "=" and "<=", the other "=" once
    assert f["has_tautology"] == 1 and f["has_multiline_comment"] == 1 and f["has_comment"] == 1
    assert f["c_arith"] == 4  # two dashes, the star of "/*" and the slash of "*/"
    assert f["c_num"] == 4  # three digits and the superscript
    g = li(spark, "substring(nullable, order_by)")
    assert g["has_string_functions"] == 1 and g["has_null"] == 0 and g["has_order"] == 0
    assert g["has_connection_keywords"] == 1  # the "or" of "order"
    assert li(spark, "")["len_query"] == 0


def test_li_is_one_projection(spark):
    plan = lexical.li_columns(texts(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_loginov_counts(spark):
    df = texts(spark, "SELECT * FROM users WHERE id = 1")
    empty = spark.createDataFrame([], "run string")
    f = tokens.loginov_columns(df, empty).first()
    assert (f.n_anomalous_schars, f.s1_n_keywords, f.s1_n_alpha, f.s1_n_numeric, f.s1_n_mixed) == (2, 3, 2, 1, 0)


def test_unseen_special_run(spark):
    valid = tokens.learn_special_runs(texts(spark, "SELECT a FROM t WHERE b = 1"))
    target = texts(spark, "SELECT a FROM t # x", "a = b")
    assert [r[2] for r in tokens.loginov_columns(target, valid).orderBy("row_id").collect()] == [1, 0]
    many = spark.range(3000).select(F.concat(F.lit("#"), F.repeat(F.lit("!"), F.col("id").cast("int"))).alias("run"))
    assert [r[2] for r in tokens.loginov_columns(target, valid.unionByName(many)).orderBy("row_id").collect()] == [0, 0]
    none = texts(spark, None, "")
    assert [r[2] for r in tokens.loginov_columns(none, valid).collect()] == [0, 0]


def test_plus_joins_in_the_second_view(spark):
    f = tokens.loginov_columns(texts(spark, "ab'cd+12 x1"), spark.createDataFrame([], "run string")).first()
    assert (f.s1_n_alpha, f.s2_n_alpha, f.s2_n_numeric, f.s2_n_mixed) == (2, 1, 1, 1)


def test_keyword_lists(spark):
    assert "SELECT" in engine_keywords(spark) and len(CORE_KEYWORDS) < 200
    words = spark.createDataFrame([("users",), ("id",)], "word string")
    f = tokens.loginov_columns(texts(spark, "select id from users"), spark.createDataFrame([], "run string"), keywords=words).first()
    assert f.s1_n_keywords == 2


def test_tfidf_cap_and_norm(spark):
    df = texts(spark, *[f"word{i} common term{i % 7}" for i in range(300)])
    ext = build_extractor("tfidf").fit(df)
    assert ext.dim == 200
    rows = ext.transform(df).collect()
    assert all(abs(sum(v * v for v in r.features["values"]) - 1.0) < 1e-9 for r in rows)


def test_open_and_capped_counts_agree(spark):
    df = texts(spark, "a bb bb ccc", "bb dddd", "")
    capped = build_extractor("cv", max_features=10).fit(df).transform(df).orderBy("row_id").collect()
    opened = build_extractor("cv").fit(df).transform(df).orderBy("row_id").collect()
    for a, b in zip(capped, opened, strict=True):
        assert sorted(a.features["values"]) == sorted(b.features["values"])
    assert sorted(capped[0].features["values"]) == [1.0, 2.0]


def test_roles(spark):
    df = texts(spark, "SELECT a, b, count(*) FROM t1 WHERE x = 'y' AND n >= 10; DROP TABLE z")
    got = [(t.value, t.role) for t in roles.tagged_tokens(df).first().tagged]
    assert got[:4] == [("SELECT", "DML"), ("a", "Identifierlist"), ("b", None), ("count", None)]
    assert ("WHERE", "Where") in got and ("'y'", "Quot") in got and (">=", "Comparison") in got and ("10", "Int") in got
    assert got[-1] == (";", "Punct")  # only the first statement


def test_long_lists_do_not_overflow(spark):
    df = texts(spark, "x IN (" + ", ".join(map(str, range(20000))) + ")")
    assert len(roles.tagged_tokens(df).first().tagged) == 20004


def test_role_views(spark):
    v = roles.view_texts(roles.tagged_tokens(texts(spark, "WHERE sleep(5)"))).first()
    assert (v["T"], v["C"], v["E"]) == ("WHERE sleep ( )", "Where Func Par Int Par", "Where WHERE Func sleep Par Int Par")


TREE = "0:900:1:CREATE:TABLE:select a|1:901:2:READ::from|bad:node|2:x:3:READ:TABLE:||-||tail"


def trace_frame(spark):
    rows = [(0, TREE, 3, 1, 0, 2, 1), (1, None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "row_id long, semantic_tree string, n_terminal int, n_nonterminal int, is_syntax_error int, depth int, n_parser_invoc int"
    )


def test_trace_nodes_and_counts(spark):
    df = trace_frame(spark)
    nodes = df.select(TR.trace_nodes("semantic_tree").alias("n")).collect()
    assert [len(r.n) for r in nodes] == [3, 0] and nodes[0].n[1].tag2 == ""
    counts = {(r.row_id, r.tag): r.n for r in TR.trace_tag_counts(df).collect()}
    assert counts == {(0, "CREATE"): 1, (0, "TABLE"): 2, (0, "READ"): 2}
    rules = {r.tag: r.n for r in TR.trace_tag_counts(df, "ruleid").collect()}
    assert rules == {"kind_900": 1, "kind_901": 1}


def test_trace_defaults_and_vector(spark):
    fields = TR.syntactic_fields(trace_frame(spark)).orderBy("row_id").collect()
    assert fields[1].is_syntax_error == 1.0 and fields[1].depth == 0.0 and fields[0].is_syntax_error == 0.0
    for mode, width in (("expert", 5 + 17 + 3), ("claude", 5 + 20 + 3), ("ruleid", 5 + 1013 + 3)):
        rows = TR.trace_vector(trace_frame(spark), mode).orderBy("row_id").collect()
        assert len(rows[0].trace_features) == width == len(TR.trace_feature_names(mode))
        assert rows[0].trace_features[-3:] == [1.0, 1.0, 1.0] and rows[1].trace_features[-3:] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        TR.tag_names("nope")


def test_pooling(spark):
    states = [[float(i)] for i in range(6)]
    df = spark.createDataFrame([(states, [0, 0, 0, 0, 1, 1]), (states, [0, 0, 0, 1, 1, 1])], "s array<array<double>>, m array<int>")
    assert [r[0][0] for r in df.select(pooling.masked_mean_pool("s", "m")).collect()] == [4.5, 4.0]
    assert [r[0][0] for r in df.select(pooling.suffix_mean_pool("s", F.lit(3))).collect()] == [4.0, 4.0]
    assert df.select(pooling.first_token_pool("s")).first()[0] == [0.0]


def test_truncation_follows_the_rounds(spark):
    def rounds(n):
        while min(n, 512) > 400:
            n = int(n * (400 / min(n, 512)))
        return n

    sizes = [10, 400, 401, 476, 1000, 20000, 10**7]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[0] for r in df.select(pooling.kept_words("n")).collect()] == [rounds(n) for n in sizes]


def test_template(spark):
    w = texts(spark, "  a b \n").select(pooling.wrap_template("full_query").alias("w")).first().w
    assert (w.full, w.pooled) == ("[INST]   a b [/INST]", "  a b [/INST]")


def test_top_terms_equal_the_full_sort(spark):
    """Skewed and flat counts, ties at the cut, few buckets (so that terms share them), and fewer terms than asked for."""
    rows = [(i, f"t{j}", 1 + (1000 // (1 + j)) + (j * i) % 3) for i in range(8) for j in range(400)]
    counts = spark.createDataFrame(rows, "row_id long, term string, n long").repartition(5)
    full = [tuple(r) for r in tokens.vocabulary(counts).orderBy(F.desc("tf"), "term").collect()]
    for buckets in (16, 1 << 20):
        for k in (1, 7, 100, 1000):
            assert [tuple(r) for r in tokens.top_terms(counts, k, buckets).collect()] == full[:k]
    flat = counts.select("row_id", "term", F.lit(2).cast("long").alias("n"))
    assert [r.term for r in tokens.top_terms(flat, 5).collect()] == sorted(f"t{j}" for j in range(400))[:5]
    plan = tokens.top_terms(counts, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") > plan.index("Exchange hashpartitioning(term")  # terms are filtered before they move
    assert tokens.top_terms(counts.limit(0), 3).collect() == []
