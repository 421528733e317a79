"""Scans, predicates, sampling, joins and grid bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilar.functions import lexical
from vigilar.operators import fingerprint as fp
from vigilar.operators import sampling as S
from vigilar.plans import extractors as X
from vigilar.session import scratch_dir
from vigilar.sources import scenarios as SC
from vigilar.sources import sinks, versions
from vigilar.sources.tables import corpus, runs, table, traces
from vigilar.workload.common import CORPUS, RUNS, query
from vigilar.workload.features import TRACES


def md5_of(purpose, seed, row_id="row_id") -> str:
    return f"md5(concat('{purpose}:{seed}:', {row_id}::VARCHAR))"


@query("scan_split", f"WITH {CORPUS} SELECT row_id, full_query, label, split FROM corpus WHERE split = 'train'")
def scan_split(spark, sf):
    return corpus(spark, sf).where(F.col("split") == "train").select("row_id", "full_query", "label", "split")


@query(
    "scan_drift_partitions",
    f"""WITH {CORPUS} SELECT part, label, count(*) AS n FROM (
      SELECT label, CASE WHEN drift_set = 'origin' AND split = 'train' THEN 'origin_train'
        WHEN drift_set = 'origin' AND split = 'test' THEN 'origin_test'
        WHEN drift_set = 'shifted' AND split = 'test' THEN 'shifted_test' END AS part FROM corpus)
      WHERE part IS NOT NULL GROUP BY part, label""",
)
def scan_drift_partitions(spark, sf):
    parts = SC.drift_partitions(corpus(spark, sf))
    return parts.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


_CAPPED = """counted AS (SELECT *, count(*) OVER (PARTITION BY {strata}, label) AS c,
    count(*) OVER (PARTITION BY {strata}) AS n,
    row_number() OVER (PARTITION BY {strata}, label ORDER BY {h}, row_id) AS rn FROM {src})"""


@query(
    "scan_fsl",
    f"""WITH {CORPUS}, tests AS (SELECT * FROM corpus WHERE domain = 'a' AND split = 'test'),
    {_CAPPED.format(strata="domain", h=md5_of("cap", 7), src="tests")}
    SELECT row_id, label, 'test' AS part FROM counted
      WHERE n <= 100 OR rn <= round_even(c * (100.0::DOUBLE / n), 0)
    UNION ALL SELECT row_id, label, 'train' FROM corpus WHERE domain = 'a' AND split = 'train'""",
)
def scan_fsl(spark, sf):
    train, test = SC.fewshot_sets(corpus(spark, sf), "a", 100, 7)
    return test.select("row_id", "label", F.lit("test").alias("part")).unionByName(
        train.select("row_id", "label", F.lit("train").alias("part"))
    )


@query(
    "scan_csv_roundtrip",
    f"""WITH {CORPUS} SELECT full_query, label, attack_technique FROM corpus
      WHERE split = 'test' AND length(full_query) > 0""",
)
def scan_csv_roundtrip(spark, sf):
    """The corpus written as a scenario CSV file and read back through the labelled reader."""
    path = f"{scratch_dir(spark, 'csv')}/single.csv"
    rows = corpus(spark, sf).drop("row_id", "query_template_id")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)
    cols = ("full_query", "label", "attack_technique")
    back = SC.read_split(spark, path, "test", cols)
    return back.select(*cols)


@query(
    "read_scenario_splits",
    f"""WITH {CORPUS} SELECT concat(domain, '-', domain) AS scenario, split, label, count(*) AS n, count(*) AS n_ids
    FROM corpus WHERE length(full_query) > 0 GROUP BY domain, split, label""",
)
def read_scenario_splits(spark, sf):
    """Scenario files on shared storage, written as CSV, converted, and read by family and name; every row has its own id."""
    root = scratch_dir(spark, "scenarios")
    rows = corpus(spark, sf).where(F.length("full_query") > 0).drop("row_id")
    out = None
    for domain in SC.DOMAINS:
        name = SC.in_domain(domain)
        csv = rows.where(F.col("domain") == domain).write.options(header=True, escape='"', quoteAll=True, nullValue="", emptyValue="")
        csv.csv(f"{root}/{name}.csv")
        SC.convert_scenario(spark, root, "multi", name)
        for split in ("train", "test"):
            one = SC.read_scenario(spark, root, "multi", name, split, ("full_query", "label", "split")).withColumn("scenario", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("scenario", "split", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_ids"))


@query(
    "read_whole_sample",
    f"""WITH {CORPUS} SELECT row_id, split FROM corpus ORDER BY {md5_of('sample', 7)}, row_id LIMIT 250""",
)
def read_whole_sample(spark, sf):
    """A sample of a whole numbered table, drawn before splitting."""
    path = f"{scratch_dir(spark, 'whole')}/a-a.parquet"
    corpus(spark, sf).write.parquet(path)
    return SC.read_whole_sample(spark, path, limit=250).select("row_id", "split")


@query(
    "target_sources",
    "SELECT d AS target, concat(d, '-', d) AS in_domain, concat(replace('abcd', d, ''), '-', d) AS lodo, concat(d, '-', d, '.csv') AS file FROM (SELECT unnest(['a','b','c','d']) AS d)",
)
def target_sources(spark, sf):
    """The scenarios and the file behind every target domain of the few-shot family."""
    dim = SC.scenario_dimension(spark)
    own = dim.where((F.col("family") == "fewshot") & (F.col("suite") == "all")).select(F.col("test_domain").alias("target"), "file")
    multi = dim.where((F.col("family") == "multi") & (F.col("suite") == "all"))
    found = multi.groupBy(F.col("test_domain").alias("target")).agg(
        F.max(F.when(F.col("kind") == "in_domain", F.col("scenario"))).alias("in_domain"), F.max(F.when(F.col("kind") == "lodo", F.col("scenario"))).alias("lodo")
    )
    return found.join(own, "target")


@query(
    "manifest_entries",
    """SELECT concat('part-', source) AS file, count(*) AS bytes, md5(concat(min(doc_id), ':', max(doc_id), ':', sum(doc_id))) AS md5
       FROM documents GROUP BY source""",
)
def manifest_entries(spark, sf):
    """A manifest with one entry per source, written as nested JSON and read back."""
    docs = table(spark, sf, "documents")
    ids = F.concat_ws(":", F.min("doc_id"), F.max("doc_id"), F.sum("doc_id"))
    entries = docs.groupBy("source").agg(F.count(F.lit(1)).alias("bytes"), F.md5(ids).alias("md5"))
    entry = F.struct(F.lit("in_domain").alias("kind"), "bytes", "md5")
    files = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("part-"), "source"), entry)))
    doc = entries.agg(F.create_map(F.lit("main"), F.struct(files.alias("files"))).alias("groups"))
    path = f"{scratch_dir(spark, 'manifest')}/manifest"
    doc.coalesce(1).write.json(path)
    return SC.manifest_entries(spark, path).select("file", "bytes", "md5")


@query(
    "file_integrity",
    """SELECT concat(n, '.parquet') AS file, CASE WHEN n = 'events' THEN 'bad_hash' ELSE 'ok' END AS status FROM
    (SELECT unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations']) AS n)""",
)
def file_integrity(spark, sf):
    """Checks the given tables, each a file or a folder of them, against a manifest made from their own bytes, one table's entries falsified."""
    path = f"{scratch_dir(spark, 'manifest')}/manifest"
    files = SC.files_below(spark, sf, "*.parquet")
    files = files.join(SC.file_digests(spark, sf, [r["path"] for r in files.select("path").collect()], pattern="*.parquet"), "path")
    bad = F.split_part("file", F.lit("/"), F.lit(1)) == "events.parquet"
    entry = F.struct(
        F.lit("in_domain").alias("kind"),
        F.col("length").alias("bytes"),
        F.when(bad, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")).alias("sha256"),
    )
    one = files.agg(F.map_from_entries(F.collect_list(F.struct("file", entry))).alias("files"))
    one.select(F.create_map(F.lit("main"), F.struct("files")).alias("groups")).write.json(path)
    return SC.verify_tables(SC.manifest_entries(spark, path), sf).select("file", "status")


@query(
    "drop_null_required",
    """SELECT doc_id AS row_id, text AS full_query, toxic AS label FROM documents JOIN labels USING (doc_id)
       WHERE toxic IS NOT NULL AND text IS NOT NULL""",
)
def drop_null_required(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    named = docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("full_query"), F.col("toxic").cast("string").alias("label"))
    return SC.clean_required(named)


@query("split_normals", f"WITH {CORPUS} SELECT row_id, label FROM corpus WHERE label = 0")
def split_normals(spark, sf):
    return corpus(spark, sf).where(F.col("label") == 0).select("row_id", "label")


@query(
    "stratified_cap",
    f"""WITH {CORPUS}, {_CAPPED.format(strata="1", h=md5_of("cap", 3), src="corpus")}
    SELECT row_id, label FROM counted WHERE n <= 300 OR rn <= round_even(c * (300.0::DOUBLE / n), 0)""",
)
def stratified_cap(spark, sf):
    return S.stratified_cap(corpus(spark, sf), 300, 3).select("row_id", "label")


@query("sample_n", f"SELECT doc_id AS row_id FROM documents ORDER BY {md5_of('sample', 7, 'doc_id')}, doc_id LIMIT 250")
def sample_n(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    return S.sample_n(docs, 250, 7)


@query("sample_fraction", f"SELECT event_id AS row_id FROM events WHERE {md5_of('fraction', 7, 'event_id')} < '{S.fraction_bound(0.2)}'")
def sample_fraction(spark, sf):
    return S.sample_fraction(table(spark, sf, "events").select(F.col("event_id").alias("row_id")), 0.2, 7)


@query(
    "fit_val_split",
    f"""WITH {CORPUS} SELECT row_id, CASE WHEN {md5_of('split', 7)} < '{S.fraction_bound(0.1)}' THEN 'val' ELSE 'fit' END AS role
    FROM corpus WHERE label = 0 AND split = 'train'""",
)
def fit_val_split(spark, sf):
    benign = corpus(spark, sf).where((F.col("label") == 0) & (F.col("split") == "train"))
    return S.fit_val_roles(benign, 0.1, 7).select("row_id", "role")


@query(
    "fewshot_prefix_samples",
    f"""WITH {CORPUS}, seeds AS (SELECT unnest([0, 1, 2, 3, 4]) AS seed), ks AS (SELECT unnest([5, 10, 50]) AS k),
    placed AS (SELECT seed, row_id, row_number() OVER (PARTITION BY seed
        ORDER BY md5(concat('budget:', seed::VARCHAR, ':', row_id::VARCHAR)), row_id) AS place
      FROM corpus, seeds WHERE label = 0 AND split = 'train')
    SELECT k, seed, place::INTEGER AS place, row_id FROM placed JOIN ks ON place <= k""",
)
def fewshot_prefix_samples(spark, sf):
    benign = corpus(spark, sf).where((F.col("label") == 0) & (F.col("split") == "train"))
    return S.prefix_samples(benign.select("row_id"), [5, 10, 50], [0, 1, 2, 3, 4])


@query(
    "drift_template_split",
    f"""WITH {CORPUS}, t AS (SELECT DISTINCT statement_type, query_template_id FROM corpus),
    h AS (SELECT *, ntile(2) OVER (PARTITION BY statement_type
      ORDER BY {md5_of('template', 7, 'query_template_id')}, query_template_id) AS half FROM t)
    SELECT row_id, CASE WHEN half = 1 THEN 'origin' ELSE 'shifted' END AS drift_set
    FROM corpus JOIN h USING (statement_type, query_template_id)""",
)
def drift_template_split(spark, sf):
    return S.template_halves(corpus(spark, sf)).select("row_id", "drift_set")


_ROLES = ", ".join(
    f"('{s}','{k}','{d}','{p}')"
    for dom in SC.DOMAINS
    for s, k, d, p in (
        [(SC.in_domain(dom), "in_domain", dom, "train"), (SC.in_domain(dom), "in_domain", dom, "test")]
        + [(SC.lodo(dom), "lodo", o, "train") for o in SC.DOMAINS if o != dom]
        + [(SC.lodo(dom), "lodo", dom, "test")]
    )
)


@query(
    "lodo_scenarios",
    f"""WITH {CORPUS}, roles(scenario, kind, domain, split) AS (VALUES {_ROLES}),
    rws AS (SELECT * FROM corpus JOIN roles USING (domain, split)),
    counted AS (SELECT *, count(*) OVER (PARTITION BY scenario, split, label) AS c,
      count(*) OVER (PARTITION BY scenario, split) AS n,
      row_number() OVER (PARTITION BY scenario, split, label ORDER BY {md5_of('cap', 7)}, row_id) AS rn FROM rws),
    sized AS (SELECT *, min(n) OVER (PARTITION BY split) AS cap FROM counted)
    SELECT scenario, kind, split, row_id, label FROM sized
    WHERE n <= cap OR rn <= round_even(c * (cap::DOUBLE / n), 0)""",
)
def lodo_scenarios(spark, sf):
    return SC.build_scenarios(corpus(spark, sf)).select("scenario", "kind", "split", "row_id", "label")


@query(
    "capped_then_split",
    f"""WITH {CORPUS}, roles(scenario, kind, domain, split) AS (VALUES {_ROLES}),
    rws AS (SELECT * FROM corpus JOIN roles USING (domain, split)),
    counted AS (SELECT *, count(*) OVER (PARTITION BY scenario, split, label) AS c,
      count(*) OVER (PARTITION BY scenario, split) AS n,
      row_number() OVER (PARTITION BY scenario, split, label ORDER BY {md5_of('cap', 7)}, row_id) AS rn FROM rws),
    sized AS (SELECT *, min(n) OVER (PARTITION BY split) AS cap FROM counted),
    kept AS (SELECT * FROM sized WHERE n <= cap OR rn <= round_even(c * (cap::DOUBLE / n), 0))
    SELECT scenario, count(*) AS n, count(*) FILTER ({md5_of('split', 7)} < '{S.fraction_bound(0.1)}') AS n_val,
      count(*) FILTER ({md5_of('fraction', 7)} < '{S.fraction_bound(0.2)}') AS n_fifth,
      count(*) FILTER ({md5_of('split', 7)} < '{S.fraction_bound(0.1)}' AND {md5_of('fraction', 7)} < '{S.fraction_bound(0.2)}') AS n_val_of_fifth
    FROM kept WHERE label = 0 AND split = 'train' GROUP BY scenario""",
)
def capped_then_split(spark, sf):
    """Calibration rows and the fraction of slow extractors, of scenarios that were capped before."""
    rows = SC.build_scenarios(corpus(spark, sf)).where((F.col("label") == 0) & (F.col("split") == "train"))
    rows = S.fit_val_roles(rows, 0.1, 7).withColumn("fifth", S.in_fraction(S.FRACTION, 0.2, 7))
    val = F.col("role") == "val"
    return rows.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(val).alias("n_val"), F.count_if("fifth").alias("n_fifth"), F.count_if(val & F.col("fifth")).alias("n_val_of_fifth")
    )


@query(
    "scenario_sizes",
    f"""WITH {CORPUS}, roles(scenario, kind, domain, split) AS (VALUES {_ROLES})
    SELECT scenario, kind, split, count(*) AS n_rows, sum(label)::BIGINT AS n_attacks
    FROM corpus JOIN roles USING (domain, split) GROUP BY scenario, kind, split""",
)
def scenario_sizes(spark, sf):
    """Cells joined with their manifest-like entry (kind) and counted."""
    rows = SC.build_scenarios(corpus(spark, sf), equal_size=False)
    return rows.groupBy("scenario", "kind", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("n_attacks")
    )


_OBSERVE = ", ".join(f"('{n}', '{e.label}', {str(e.observes_insider).lower()})" for n, e in X.EXTRACTORS.items())


@query(
    "extractor_lookup",
    f"""WITH {RUNS}, dim(extractor, label, observes_insider) AS (VALUES {_OBSERVE})
    SELECT extractor, label, observes_insider, count(*) AS n_runs FROM runs JOIN dim USING (extractor)
    GROUP BY extractor, label, observes_insider""",
)
def extractor_lookup(spark, sf):
    """Runs joined with the extractor dimension (labels, insider visibility)."""
    from vigilar.plans.reports import with_cell_tags

    dim = F.broadcast(X.extractor_dimension(spark).select("extractor", "label", "observes_insider"))
    joined = with_cell_tags(runs(spark, sf)).join(dim, "extractor")
    return joined.groupBy("extractor", "label", "observes_insider").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "unknown_names",
    f"""WITH {RUNS}, dim(extractor, label, observes_insider) AS (VALUES {_OBSERVE}),
    req AS (SELECT extractor AS name FROM runs UNION ALL SELECT concat(event_type, '-x') FROM events)
    SELECT name, CASE WHEN name NOT IN (SELECT extractor FROM dim) THEN 'unknown' ELSE 'duplicate' END AS problem FROM req
    GROUP BY name HAVING count(*) > 1 OR name NOT IN (SELECT extractor FROM dim)""",
)
def unknown_names(spark, sf):
    """Requested names that no extractor has, or that are requested twice."""
    from vigilar.plans.reports import name_problems, with_cell_tags

    asked = with_cell_tags(runs(spark, sf)).select(F.col("extractor").alias("name")).unionByName(
        table(spark, sf, "events").select(F.concat("event_type", F.lit("-x")).alias("name"))
    )
    known = X.extractor_dimension(spark).select(F.col("extractor").alias("name"))
    return name_problems(asked, known)


@query(
    "dataset_fingerprint",
    """WITH l0 AS (SELECT doc_id AS id, md5(text) AS h FROM documents),
    l1 AS (SELECT id >> 12 AS id, md5(string_agg(h, '' ORDER BY id)) AS h FROM l0 GROUP BY id >> 12),
    l2 AS (SELECT id >> 12 AS id, md5(string_agg(h, '' ORDER BY id)) AS h FROM l1 GROUP BY id >> 12),
    l3 AS (SELECT id >> 12 AS id, md5(string_agg(h, '' ORDER BY id)) AS h FROM l2 GROUP BY id >> 12),
    l4 AS (SELECT id >> 12 AS id, md5(string_agg(h, '' ORDER BY id)) AS h FROM l3 GROUP BY id >> 12),
    l5 AS (SELECT id >> 12 AS id, md5(string_agg(h, '' ORDER BY id)) AS h FROM l4 GROUP BY id >> 12),
    l6 AS (SELECT id >> 12 AS id, md5(string_agg(h, '' ORDER BY id)) AS h FROM l5 GROUP BY id >> 12)
    SELECT md5(concat('li:', h)) AS fingerprint FROM l6""",
)
def dataset_fingerprint(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return fp.table_fingerprint(docs, "text", salt="li")


@query(
    "resume_left_anti",
    f"WITH {CORPUS} SELECT row_id FROM corpus WHERE row_id NOT IN (SELECT row_id FROM corpus WHERE split = 'train')",
)
def resume_left_anti(spark, sf):
    rows = corpus(spark, sf).select("row_id", "split")
    return sinks.remaining_rows(rows, rows.where(F.col("split") == "train")).select("row_id")


@query("resumable_traces", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM documents")
def resumable_traces(spark, sf):
    """Trace features appended in slices, stopped half-way, then resumed: every row once."""
    from vigilar.functions.traces import syntactic_fields

    rows = traces(spark, sf)
    path = f"{scratch_dir(spark, 'resume')}/features"
    compute = lambda d: syntactic_fields(d.drop("full_query", "semantic_tree"))
    compute(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(4)) < 2)).write.parquet(path)
    out = sinks.resumable_append(rows, compute, path, steps=4)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids"))


@query(
    "feature_store_hit",
    f"WITH {CORPUS} SELECT count(*) AS n_rows, sum(length(full_query))::BIGINT AS total_len FROM corpus",
)
def feature_store_hit(spark, sf):
    """Features computed through the store; the second read must come from it."""
    rows = corpus(spark, sf).select("row_id", "full_query")
    store = sinks.FeatureStore(scratch_dir(spark, "store"))
    store.features(rows, lexical.li_columns, "li")

    def never(_):
        raise AssertionError("the stored features were not used")

    return store.features(rows, never, "li").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("len_query").cast("bigint").alias("total_len")
    )


@query(
    "feature_store_inputs",
    f"WITH {TRACES} SELECT count(*) AS n_rows, sum(coalesce(n_words % 13, 0))::DOUBLE AS before, sum(coalesce(n_words % 13, 0) + 1)::DOUBLE AS after, 2::BIGINT AS computed FROM traces",
)
def feature_store_inputs(spark, sf):
    """Equal texts with other traces must be computed anew, and only those."""
    rows = traces(spark, sf).withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("label", F.lit(0))
    store, calls = sinks.FeatureStore(scratch_dir(spark, "store")), []

    def compute(d):
        calls.append(1)
        return d.withColumn("own_depth", F.col("depth").cast("double"))

    inputs = ["semantic_tree", "depth"]
    total = lambda d: store.features(d, compute, "trace", inputs=inputs).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("own_depth").alias("s")).first()
    first, changed, again = total(rows), total(rows.withColumn("depth", F.col("depth") + 1)), total(rows.withColumn("label", F.lit(1)))
    assert again == first
    return spark.createDataFrame([(first["n_rows"], first["s"], changed["s"], len(calls))], "n_rows long, before double, after double, computed long")


@query(
    "results_rewrite_cell",
    f"""WITH {RUNS} SELECT extractor, scenario, CASE WHEN extractor = 'li' AND scenario = 'a-a' THEN 0 ELSE count(*) END AS n_runs
    FROM done GROUP BY extractor, scenario""",
)
def results_rewrite_cell(spark, sf):
    """A result table by cell; a rerun of one cell replaces that cell only."""
    from vigilar.plans.reports import finished_runs, with_cell_tags

    counts = with_cell_tags(finished_runs(runs(spark, sf))).groupBy("extractor", "scenario").agg(F.count(F.lit(1)).alias("n_runs"))
    path = f"{scratch_dir(spark, 'results')}/results"
    cell = ["extractor", "scenario"]
    sinks.write_results(counts, path, cell)
    again = counts.where((F.col("extractor") == "li") & (F.col("scenario") == "a-a")).withColumn("n_runs", F.lit(0).cast("bigint"))
    sinks.write_results(again, path, cell)
    return spark.read.schema("n_runs bigint, extractor string, scenario string").parquet(path).select(*cell, "n_runs")


@query(
    "versioned_cells",
    """SELECT event_type, event_id, CASE WHEN event_type IN ('click', 'error') THEN value + 1 ELSE value END AS value FROM events
    WHERE event_type IS NOT NULL""",
)
def versioned_cells(spark, sf):
    """Cells of a result table that are committed, partly committed again, and once only written."""
    path, cell = f"{scratch_dir(spark, 'versions')}/results", ["event_type"]
    rows = table(spark, sf, "events").where("event_type is not null").select("event_type", "event_id", "value")
    first = versions.commit(rows, path, cell)
    again = rows.where(F.col("event_type").isin("click", "error")).withColumn("value", F.col("value") + 1)
    versions.commit(again, path, cell, expected=first)
    rows.withColumn("value", F.lit(0.0)).write.partitionBy(*cell).parquet(f"{path}/data/lost")  # a writer that died before its commit
    return versions.read_version(spark, path, cell).select("event_type", "event_id", "value")
