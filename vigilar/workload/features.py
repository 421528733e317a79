"""Text, trace and embedding features."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilar.functions import lexical, pooling, roles, tokens
from vigilar.functions import traces as TR
from vigilar.functions.chars import SPACE, WORD, digit_class, upper_class
from vigilar.functions.keywords import CORE_KEYWORDS
from vigilar.operators import scaling
from vigilar.sources.tables import TRACE_TAGS, corpus, page_corpus, table, texts, traces, vectors
from vigilar.workload.common import CORPUS, query, r6, rounded, sql_list

KW = sql_list(CORE_KEYWORDS)
DOCS = "src AS (SELECT doc_id AS row_id, text AS full_query FROM documents)"
PAGES = "src AS (SELECT page_id AS row_id, html AS full_query FROM pages)"
TURNS = "src AS (SELECT conv_id * 1000 + turn AS row_id, text AS full_query FROM conversations)"


def docs(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").toDF("row_id", "full_query")


def turns(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("full_query")
    )


# ---- lexical features -----------------------------------------------------------------


def li_sql(src: str, tautology: bool = True) -> str:
    """The 32 features stated with RE2 patterns; the self-comparison test compares list elements."""
    has = lambda *ws: (
        f"CAST(regexp_matches(q, '(^|[^{WORD}])({'|'.join(ws)})($|[^{WORD}])') AS INTEGER)"
    )
    sub = lambda ws: "CAST(" + " OR ".join(f"contains(q, '{w}')" for w in ws) + " AS INTEGER)"
    n = lambda s: f"((length(x) - length(replace(x, '{s}', ''))) / {len(s)})::INTEGER"
    cls = lambda c: f"length(regexp_replace(x, '[^{c}]', '', 'g'))::INTEGER"
    letters = WORD.replace("_", "")
    special = f"{letters}{digit_class()}{upper_class()}{SPACE}" + r"/*+\-\[\](){}"
    cols = {
        "len_query": "length(x)::INTEGER",
        "has_comment": "CAST(contains(x, '--') OR contains(x, '#') AS INTEGER)",
        "has_query_keywords": has(*lexical.QUERY_KEYWORDS),
        "has_string_functions": has(*lexical.STRING_FUNCTIONS),
        "has_database_keywords": sub(lexical.DATABASE_KEYWORDS),
        "has_connection_keywords": sub(lexical.CONNECTION_KEYWORDS),
        "has_file_keywords": sub(lexical.FILE_KEYWORDS),
        "c_comparison": "(" + " + ".join(n(o) for o in lexical.COMPARISON_OPERATORS) + ")::INTEGER",
        "c_num": cls(digit_class()),
        "c_upper": cls(upper_class()),
        "c_space": cls(SPACE),
        "c_special": f"length(regexp_replace(x, '[{special}]', '', 'g'))::INTEGER",
        "c_arith": f"({n('+')} + {n('-')} + {n('/')} - {n('/*')} + {n('*')} - {n('*/')})::INTEGER",
        "c_square_brackets": cls(r"\[\]"),
        "c_round_brackets": cls("()"),
        "c_curly_brackets": cls("{}"),
        "has_multiline_comment": "CAST(contains(x, '/*') OR contains(x, '*/') AS INTEGER)",
        "has_tautology": f"""CAST(len(list_filter(range(1, len(string_split(x, '='))), lambda i:
            len(list_filter(range(1, least(length(regexp_extract(string_split(x, '=')[i], '[{WORD}]*$')),
              length(regexp_extract(string_split(x, '=')[i + 1], '^[{WORD}]*'))) + 1), lambda m:
              right(string_split(x, '=')[i], m::INTEGER) = left(string_split(x, '=')[i + 1], m::INTEGER))) > 0)) > 0 AS INTEGER)""",
    }
    cols |= {f"has_{w}": has(w) for w in lexical.WORD_FLAGS}
    if not tautology:
        cols.pop("has_tautology")
    picked = ", ".join(f"{cols[c]} AS {c}" for c in lexical.LI_FEATURES if c in cols)
    return f"WITH {src} SELECT row_id, {picked} FROM (SELECT row_id, full_query AS x, lower(full_query) AS q FROM src)"


@query("li_features_docs", li_sql(DOCS))
def li_features_docs(spark, sf):
    return lexical.li_columns(docs(spark, sf)).drop("full_query")


@query("li_features_pages", li_sql(PAGES))
def li_features_pages(spark, sf):
    return lexical.li_columns(page_corpus(spark, sf)).drop("full_query")


@query("li_features_urls", li_sql("src AS (SELECT page_id AS row_id, url AS full_query FROM pages)"))
def li_features_urls(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("full_query"))
    return lexical.li_columns(urls).drop("full_query")


# ---- token classes ---------------------------------------------------------------------

_RUN = f"[^a-zA-Z0-9{SPACE}]+"


@query(
    "loginov_valid_schars",
    f"""WITH {CORPUS} SELECT DISTINCT unnest(regexp_extract_all(full_query, '{_RUN}')) AS run FROM corpus
    WHERE label = 0 AND split = 'train'""",
)
def loginov_valid_schars(spark, sf):
    return tokens.learn_special_runs(corpus(spark, sf).where((F.col("label") == 0) & (F.col("split") == "train")))


def _classes(p: str) -> str:
    kw = f"list_contains({KW}, upper(t))"
    return f"""len(list_filter({p}, lambda t: {kw}))::INTEGER AS {p}_n_keywords,
      len(list_filter({p}, lambda t: NOT {kw} AND regexp_full_match(t, '[a-zA-Z]+')))::INTEGER AS {p}_n_alpha,
      len(list_filter({p}, lambda t: NOT {kw} AND regexp_full_match(t, '[0-9]+')))::INTEGER AS {p}_n_numeric,
      len(list_filter({p}, lambda t: NOT {kw} AND regexp_matches(t, '[a-zA-Z]') AND regexp_matches(t, '[0-9]')))::INTEGER AS {p}_n_mixed"""


@query(
    "loginov_features",
    f"""WITH {CORPUS}, valid AS (SELECT DISTINCT unnest(regexp_extract_all(full_query, '{_RUN}')) AS run FROM corpus
      WHERE label = 0 AND split = 'train'),
    hits AS (SELECT row_id, unnest(regexp_extract_all(full_query, '{_RUN}')) AS run FROM corpus),
    news AS (SELECT row_id, count(*) AS n FROM hits WHERE run NOT IN (SELECT run FROM valid) GROUP BY row_id),
    t AS (SELECT row_id, list_filter(regexp_split_to_array(regexp_replace(full_query, '{_RUN}', ' ', 'g'), '[{SPACE}]+'), lambda t: t <> '') AS s1,
      list_filter(regexp_split_to_array(regexp_replace(full_query, '[^a-zA-Z0-9{SPACE}+]+', '', 'g'), '[{SPACE}+]+'), lambda t: t <> '') AS s2 FROM corpus)
    SELECT t.row_id, coalesce(n, 0)::INTEGER AS n_anomalous_schars, {_classes("s1")}, {_classes("s2")}
    FROM t LEFT JOIN news ON t.row_id = news.row_id""",
)
def loginov_features(spark, sf):
    rows = corpus(spark, sf).select("row_id", "full_query", "label", "split")
    valid = tokens.learn_special_runs(rows.where((F.col("label") == 0) & (F.col("split") == "train")))
    return tokens.loginov_columns(rows.select("row_id", "full_query"), valid).drop("full_query")


# ---- bag of words ------------------------------------------------------------------------

_TERMS = f"""terms AS (SELECT row_id, unnest(regexp_extract_all(lower(full_query), '[{WORD}]{{2,}}')) AS term FROM src),
  counts AS (SELECT row_id, term, count(*) AS n FROM terms GROUP BY row_id, term)"""


@query("bow_long", f"WITH {TURNS}, {_TERMS} SELECT row_id, term, n FROM counts")
def bow_long(spark, sf):
    return tokens.term_counts(turns(spark, sf))


@query(
    "vocabulary",
    f"WITH {DOCS}, {_TERMS} SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY term",
)
def vocabulary(spark, sf):
    return tokens.vocabulary(tokens.term_counts(docs(spark, sf)))


@query(
    "vocabulary_capped",
    f"""WITH {DOCS}, {_TERMS} SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY term
    ORDER BY tf DESC, term LIMIT 200""",
)
def vocabulary_capped(spark, sf):
    return tokens.vocabulary(tokens.term_counts(docs(spark, sf)), 200)


@query(
    "top_terms",
    f"""WITH {DOCS}, {_TERMS} SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY term
    ORDER BY tf DESC, term LIMIT 500""",
)
def top_terms(spark, sf):
    """The most frequent terms without a shuffle of the rare ones."""
    return tokens.top_terms(tokens.term_counts(docs(spark, sf)), 500)


@query(
    "tfidf_long",
    f"""WITH {DOCS}, {_TERMS}, vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY term ORDER BY sum(n) DESC, term LIMIT 200),
    w AS (SELECT row_id, term, n * (ln((1.0 + (SELECT count(*) FROM src)) / (1.0 + df)) + 1.0) AS v FROM counts JOIN vocab USING (term))
    SELECT row_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 6) AS weight FROM w""",
)
def tfidf_long(spark, sf):
    rows = docs(spark, sf)
    counts = tokens.term_counts(rows)
    return rounded(tokens.tfidf(counts, tokens.vocabulary(counts, 200), rows.count()), "weight")


@query(
    "cv_vectors",
    f"""WITH {TURNS}, {_TERMS}, c AS (SELECT row_id, count(*) AS n_terms, sum(n) AS n_words FROM counts GROUP BY row_id)
    SELECT src.row_id, coalesce(n_terms, 0)::INTEGER AS n_terms, coalesce(n_words, 0)::DOUBLE AS n_words
    FROM src LEFT JOIN c ON src.row_id = c.row_id""",
)
def cv_vectors(spark, sf):
    """Word-count vectors over the open vocabulary: entries and total count per row."""
    from vigilar.plans.extractors import build_extractor

    rows = turns(spark, sf)
    vec = build_extractor("cv").fit(rows).transform(rows)
    total = F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x)
    return vec.select("row_id", F.size("features.indices").alias("n_terms"), total.alias("n_words"))


# ---- token roles --------------------------------------------------------------------------


def _role_sql(t: str, nxt: str) -> str:
    word = f"regexp_full_match({t}, '{roles._NAME}')"
    lines = [f"WHEN {t} IN ('(', ')') THEN 'Par'"]
    lines += [f"WHEN upper({t}) IN ({sql_list(v)[1:-1]}) THEN '{k}'" for k, v in roles.ROLE_WORDS.items()]
    lines += [
        f"WHEN {word} AND list_contains({KW}, upper({t})) THEN 'Keyw'",
        f"WHEN {word} AND {nxt} = '(' THEN 'Func' WHEN {word} THEN 'Identifi'",
        f"WHEN regexp_full_match({t}, '0[xX][0-9a-fA-F]+') THEN 'Hexadecimal'",
        f"WHEN regexp_full_match({t}, '[0-9]+(\\.[0-9]+)?') THEN 'Int'",
        f"WHEN regexp_full_match({t}, '''[^'']*''') THEN 'Quot'",
        f"""WHEN regexp_full_match({t}, '"[^"]*"|`[^`]*`') THEN 'Identifi'""",
        f"WHEN regexp_matches({t}, '^(--|#|/\\*)') OR {t} = '''' THEN 'Escap'",
        f"WHEN {t} = '*' THEN 'Wildcard' WHEN {t} IN ('<=>', '<=', '>=', '<>', '!=', '=', '<', '>') THEN 'Comparison'",
        f"WHEN regexp_full_match({t}, '\\|\\||&&|[+\\-/%&|^~!:@]') THEN 'Oper' WHEN regexp_full_match({t}, '[,;.\\[\\]{{}}]') THEN 'Punct'",
        f"WHEN length({t}) > 1 THEN 'Identifi'",
    ]
    return "CASE " + " ".join(lines) + " ELSE 'Error' END"


_PAT = roles.TOKEN_PATTERN.replace("'", "''")


def _elem(t: str) -> str:
    return f"(ends_with({t}, ',') AND length({t}) > 1)"


def _end(t: str) -> str:
    return f"regexp_full_match({t}, '''[^'']*''|[0-9]+(\\.[0-9]+)?|{roles._NAME}|\\*')"


# One row per token with its neighbours; elements of comma lists are told apart as in the tagger.
ROLE_SQL = f"""raw AS (SELECT row_id, regexp_extract_all(full_query, '{_PAT}') AS tok FROM src),
cut AS (SELECT row_id, CASE WHEN list_contains(tok, ';') THEN tok[1:list_position(tok, ';')] ELSE tok END AS tok FROM raw),
tk AS (SELECT row_id, unnest(tok) AS t, generate_subscripts(tok, 1) AS i FROM cut),
nb AS (SELECT *, coalesce(lag(t) OVER w, '') AS bf, coalesce(lead(t) OVER w, '') AS af FROM tk WINDOW w AS (PARTITION BY row_id ORDER BY i)),
fl AS (SELECT *, {_elem("t")} AS is_el, {_elem("bf")} AS follows,
  {_elem("af")} OR {_end("af")} AS goes_on, {_end("t")} AS can_end,
  regexp_replace(t, '[ \\t\\n]*,$', '') AS bare FROM nb),
out AS (
  SELECT row_id, i, 0 AS sub, CASE WHEN is_el THEN bare ELSE t END AS value,
    CASE WHEN is_el AND follows THEN NULL WHEN is_el AND goes_on THEN 'Identifierlist'
      WHEN is_el THEN {_role_sql("bare", "','")} WHEN follows AND can_end THEN NULL ELSE {_role_sql("t", "af")} END AS role FROM fl
  UNION ALL SELECT row_id, i, 1, ',', 'Punct' FROM fl WHERE is_el AND NOT goes_on)"""

_PAGES_AND_DOCS = "src AS (SELECT page_id AS row_id, html AS full_query FROM pages UNION ALL SELECT -doc_id - 1, text FROM documents)"


def pages_and_docs(spark, sf):
    flipped = docs(spark, sf).withColumn("row_id", -F.col("row_id") - 1)
    return page_corpus(spark, sf).unionByName(flipped)


@query("token_roles", f"WITH {_PAGES_AND_DOCS}, {ROLE_SQL} SELECT row_id, coalesce(role, 'none') AS role, count(*) AS n FROM out GROUP BY ALL")
def token_roles(spark, sf):
    tagged = roles.tagged_tokens(pages_and_docs(spark, sf)).select("row_id", F.explode_outer("tagged").alias("t"))
    tagged = tagged.where(F.col("t").isNotNull())
    return tagged.groupBy("row_id", F.coalesce("t.role", F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


_VIEW_TERMS = f"""{ROLE_SQL}, v AS (
      SELECT row_id, 'T' AS view, string_agg(value, ' ' ORDER BY i, sub) FILTER (role IS NULL OR role <> 'Int') AS txt FROM out GROUP BY row_id
      UNION ALL SELECT row_id, 'C', string_agg(role, ' ' ORDER BY i, sub) FROM out GROUP BY row_id
      UNION ALL SELECT row_id, 'E', string_agg(CASE WHEN role IN ('Int', 'Punct', 'Par') THEN role
        WHEN role IS NULL THEN value ELSE role || ' ' || value END, ' ' ORDER BY i, sub) FROM out GROUP BY row_id),
    w AS (SELECT row_id, view, unnest(regexp_extract_all(lower(txt), '[{WORD}]{{2,}}')) AS term FROM v)"""


@query(
    "role_view_terms",
    f"WITH {TURNS}, {_VIEW_TERMS} SELECT row_id, view, term, count(*) AS n FROM w GROUP BY row_id, view, term",
)
def role_view_terms(spark, sf):
    return roles.view_term_counts(turns(spark, sf))


@query("role_vocabulary", f"WITH {TURNS}, {_VIEW_TERMS} SELECT DISTINCT view || ':' || term AS term FROM w")
def role_vocabulary(spark, sf):
    """Every term of every view, as the extractor learns it."""
    from vigilar.plans.extractors import build_extractor

    return build_extractor("kakisim").fit(turns(spark, sf)).table().select("term")


@query(
    "role_vectors",
    f"""WITH {TURNS}, {_VIEW_TERMS}, c AS (SELECT row_id, count(DISTINCT view || ':' || term) AS n_terms, count(*) AS n_words FROM w GROUP BY row_id)
    SELECT src.row_id, coalesce(n_terms, 0)::INTEGER AS n_terms, coalesce(n_words, 0)::DOUBLE AS n_words
    FROM src LEFT JOIN c ON src.row_id = c.row_id""",
)
def role_vectors(spark, sf):
    """Vectors over the whole vocabulary of all role views."""
    from vigilar.plans.extractors import build_extractor

    rows = turns(spark, sf)
    vec = build_extractor("kakisim").fit(rows).transform(rows)
    total = F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x)
    return vec.select("row_id", F.size("features.indices").alias("n_terms"), total.alias("n_words"))


# ---- traces ----------------------------------------------------------------------------------

TRACES = f"""tw AS (SELECT doc_id, text, list_filter(regexp_split_to_array(regexp_replace(text, '[:|]', ' ', 'g'), '[ \\t\\r\\n]+'),
    lambda w: w <> '') AS words FROM documents),
traces AS (SELECT doc_id AS row_id, text AS full_query, CASE WHEN doc_id % 10 <> 0 THEN array_to_string(list_transform(words, lambda w, i:
    CASE WHEN (i - 1) % 9 = 8 THEN concat_ws(':', (i - 1)::VARCHAR, w) ELSE concat_ws(':', (i - 1)::VARCHAR,
      (830 + (i - 1) % 1020)::VARCHAR, '7', ({sql_list(TRACE_TAGS)})[((i - 1) % 17) + 1], ({sql_list(TRACE_TAGS)})[((i + 2) % 17) + 1], w) END), '|')
    || '||-||tail:x' END AS semantic_tree,
  CASE WHEN doc_id % 10 <> 0 THEN len(words) END AS n_words FROM tw),
nodes AS (SELECT row_id, unnest(list_filter(list_transform(string_split(string_split(semantic_tree, '||-||')[1], '|'),
    lambda n: string_split(n, ':')), lambda f: len(f) = 6)) AS f FROM traces WHERE semantic_tree IS NOT NULL)"""


def _tag_sql(mode: str) -> str:
    fields = "unnest([f[4], f[5]])" if mode == "expert" else "f[4]"
    tags = sql_list(TR.tag_names(mode))
    return f"""WITH {TRACES}, hits AS (SELECT row_id, {fields} AS tag FROM nodes)
    SELECT row_id, tag, count(*) AS n FROM hits WHERE list_contains({tags}, tag) GROUP BY row_id, tag"""


def _tag_query(mode: str):
    def run(spark, sf):
        return TR.trace_tag_counts(traces(spark, sf), mode)

    return run


for _mode in TR.TAG_MODELS:
    query("trace_tag_counts" if _mode == "expert" else f"trace_tag_counts_{_mode.replace('-', '_')}", _tag_sql(_mode))(_tag_query(_mode))


@query(
    "trace_rule_histogram",
    f"""WITH {TRACES}, k AS (SELECT row_id, try_cast(f[2] AS INTEGER) AS kind FROM nodes)
    SELECT row_id, concat('kind_', kind) AS tag, count(*) AS n FROM k WHERE kind BETWEEN {TR.RULE_MIN} AND {TR.RULE_MAX} GROUP BY row_id, kind""",
)
def trace_rule_histogram(spark, sf):
    return TR.trace_tag_counts(traces(spark, sf), "ruleid")


@query(
    "trace_defaults",
    f"""WITH {TRACES} SELECT row_id, coalesce(n_words, 0)::DOUBLE AS n_terminal, coalesce(n_words // 2, 0)::DOUBLE AS n_nonterminal,
    CASE WHEN n_words IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_syntax_error, coalesce(n_words % 13, 0)::DOUBLE AS depth,
    CASE WHEN n_words IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS n_parser_invoc FROM traces""",
)
def trace_defaults(spark, sf):
    return TR.syntactic_fields(traces(spark, sf)).select("row_id", *TR.SYNTACTIC_DEFAULTS)


@query(
    "trace_keyword_stats",
    f"""WITH {TRACES}, c AS (SELECT row_id, len(list_filter(regexp_split_to_array(upper(f[6]), '[^{WORD}]+'), lambda t: list_contains({KW}, t))) AS n
      FROM nodes WHERE length(f[6]) > 0)
    SELECT t.row_id, round(coalesce(avg(n), 0), 6) AS avg_c_sqlkywds, coalesce(max(n), 0)::DOUBLE AS max_c_sqlkywds,
      coalesce(min(n), 0)::DOUBLE AS min_c_sqlkywds FROM traces t LEFT JOIN c ON t.row_id = c.row_id GROUP BY t.row_id""",
)
def trace_keyword_stats(spark, sf):
    out = TR.keyword_stats(traces(spark, sf)).select("row_id", *TR.KEYWORD_STATS)
    return rounded(out, "avg_c_sqlkywds")


@query("trace_vectors")
def trace_vectors(spark, sf):
    """Width and total of the whole trace vector, per row and tag model."""
    made = TR.trace_vectors(traces(spark, sf), TR.MODES, out="v")
    per_mode = F.array(*[F.struct(F.lit(m).alias("mode"), F.col("v")[m].alias("x")) for m in TR.MODES])
    long = made.select("row_id", F.explode_outer(per_mode).alias("m")).select("row_id", "m.mode", "m.x")
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    return long.select("mode", "row_id", F.size("x").alias("width"), r6(total).alias("total"))


# ---- embeddings ---------------------------------------------------------------------------------

# Token states: the 64 numbers of an embedding as 8 tokens of 8 numbers; the mask comes from the id.


def states(spark, sf):
    e = table(spark, sf, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    parts = F.array(*[F.slice(emb, 8 * i + 1, 8) for i in range(8)])
    mask = F.array(
        *[
            ((F.shiftright("vec_id", i) % 2 == 0) if i < 7 else F.lit(True)).cast("int")
            for i in range(8)
        ]
    )
    return e.select(F.col("vec_id").alias("row_id"), parts.alias("token_states"), mask.alias("mask"))


@query(
    "masked_mean_pool",
    """WITH x AS (SELECT vec_id, i, j, embedding[8 * (i - 1) + j]::DOUBLE AS v FROM embeddings, range(1, 9) a(i), range(1, 9) b(j)
      WHERE i = 8 OR (vec_id >> (i - 1)::INTEGER) % 2 = 0)
    SELECT vec_id AS row_id, j - 1 AS dim, round(avg(v), 6) + 0.0 AS value FROM x GROUP BY vec_id, j""",
)
def masked_mean_pool(spark, sf):
    pooled = states(spark, sf).select("row_id", F.posexplode_outer(pooling.masked_mean_pool("token_states", "mask")).alias("dim", "value"))
    return rounded(pooled.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query(
    "suffix_mean_pool",
    """WITH x AS (SELECT vec_id, j, embedding[8 * (i - 1) + j]::DOUBLE AS v FROM embeddings, range(1, 9) a(i), range(1, 9) b(j)
      WHERE i > 8 - (vec_id % 8 + 1))
    SELECT vec_id AS row_id, j - 1 AS dim, round(avg(v), 6) + 0.0 AS value FROM x GROUP BY vec_id, j""",
)
def suffix_mean_pool(spark, sf):
    pooled = pooling.suffix_mean_pool("token_states", F.col("row_id") % 8 + 1)
    out = states(spark, sf).select("row_id", F.posexplode_outer(pooled).alias("dim", "value"))
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query(
    "first_token_pool",
    "SELECT vec_id AS row_id, j - 1 AS dim, round(embedding[j]::DOUBLE, 6) + 0.0 AS value FROM embeddings, range(1, 9) b(j)",
)
def first_token_pool(spark, sf):
    out = states(spark, sf).select("row_id", F.posexplode_outer(pooling.first_token_pool("token_states")).alias("dim", "value"))
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query(
    "l2_normalize",
    """WITH x AS (SELECT vec_id, j, embedding[j]::DOUBLE AS v FROM embeddings, range(1, 65) b(j))
    SELECT vec_id AS row_id, j - 1 AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS value FROM x""",
)
def l2_normalize(spark, sf):
    out = vectors(spark, sf).select("row_id", F.posexplode_outer(pooling.l2_normalize("features")).alias("dim", "value"))
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query(
    "truncate_words",
    """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f\\v]+'), lambda t: t <> '') AS ws, text FROM documents),
    cut(doc_id, n) AS (SELECT doc_id, len(ws)::BIGINT FROM w UNION ALL
      SELECT doc_id, floor(n * (400.0::DOUBLE / least(n, 512)))::BIGINT FROM cut WHERE least(n, 512) > 400),
    final AS (SELECT doc_id, min(n) AS n FROM cut GROUP BY doc_id)
    SELECT doc_id AS row_id, n AS kept, md5(CASE WHEN n = len(ws) THEN text ELSE array_to_string(ws[1:n], ' ') END) AS text_md5
    FROM w JOIN final USING (doc_id)""",
)
def truncate_words(spark, sf):
    rows = docs(spark, sf)
    n = F.size(F.filter(F.split("full_query", r"\s+"), lambda w: w != ""))
    return rows.select(
        "row_id", pooling.kept_words(n).alias("kept"), F.md5(pooling.truncate_words("full_query")).alias("text_md5")
    )


@query(
    "wrap_template",
    """SELECT conv_id, turn, md5('[INST] ' || regexp_replace(text, '[ \\t\\r\\n\\f\\v]+$', '') || ' [/INST]') AS full_md5,
    length(regexp_replace(text, '[ \\t\\r\\n\\f\\v]+$', '') || ' [/INST]')::INTEGER AS pooled_len FROM conversations""",
)
def wrap_template(spark, sf):
    wrapped = table(spark, sf, "conversations").withColumn("w", pooling.wrap_template("text"))
    return wrapped.select("conv_id", "turn", F.md5("w.full").alias("full_md5"), F.length("w.pooled").alias("pooled_len"))


# ---- scaling ---------------------------------------------------------------------------------------

_LONG = """x AS (SELECT vec_id, label, j - 1 AS dim, embedding[j]::DOUBLE AS v FROM embeddings, range(1, 65) b(j)
  WHERE label <> 9 AND vec_id % 10 < 6)"""


@query(
    "zscore_stats",
    f"WITH {_LONG} SELECT dim, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY dim",
)
def zscore_stats(spark, sf):
    stats = scaling.column_stats(vectors(spark, sf).where(F.col("role") == "fit"))
    return rounded(stats.select(F.col("dim").cast("bigint").alias("dim"), "n", "mean", "std"), "mean", "std")


@query("maxabs_stats", f"WITH {_LONG} SELECT dim, round(max(abs(v)), 6) AS max_abs FROM x GROUP BY dim")
def maxabs_stats(spark, sf):
    stats = scaling.column_stats(vectors(spark, sf).where(F.col("role") == "fit"))
    return rounded(stats.select(F.col("dim").cast("bigint").alias("dim"), "max_abs"), "max_abs")


@query("total_variance", f"WITH {_LONG} SELECT round(var_pop(v), 6) AS variance FROM x")
def total_variance(spark, sf):
    return rounded(scaling.total_variance(vectors(spark, sf).where(F.col("role") == "fit")), "variance")


@query(
    "zscore_apply",
    f"""WITH {_LONG}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY dim)
    SELECT vec_id AS row_id, j - 1 AS dim, round((embedding[j]::DOUBLE - m) / sd, 6) + 0.0 AS value
    FROM embeddings, range(1, 65) b(j), s WHERE s.dim = j - 1""",
)
def zscore_apply(spark, sf):
    rows = vectors(spark, sf)
    scaler = scaling.fit_scaler(rows.where(F.col("role") == "fit"), "standard")
    out = rows.select("row_id", F.posexplode_outer(scaler.apply("features")).alias("dim", "value"))
    return rounded(out.withColumn("dim", F.col("dim").cast("bigint")), "value")


@query(
    "feature_blocks",
    f"""WITH {TRACES} SELECT row_id, (5 + 17 + 3 + 32)::INTEGER AS width, coalesce(n_words, 0)::DOUBLE AS first_value,
    length(full_query)::DOUBLE AS li_first FROM traces""",
)
def feature_blocks(spark, sf):
    """Trace and lexical features of the same row in one vector, without a join."""
    from vigilar.plans.extractors import build_extractor

    out = build_extractor("trace-expert").transform(traces(spark, sf))
    return out.select(
        "row_id", F.size("features").alias("width"), F.get("features", F.lit(0)).alias("first_value"), F.get("features", F.lit(25)).alias("li_first")
    )
