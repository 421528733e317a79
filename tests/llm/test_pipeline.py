from collections import Counter

import duckdb
import pytest
import corpus_pipeline
from tests.llm.cases import special_documents, table
from tests.llm.test_contamination import brute as brute_contamination
from tests.llm.test_near_duplicates import brute as brute_groups
from vigilar.llm.queries import ORACLES, QUERIES


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages_on_given_documents(spark, sf):
    """Every stage is held against brute force on its own input."""
    docs = table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]

    good = stages["quality"](spark, docs, sf).cache()
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() < docs.count()
    assert not set(rows_of(good)) - set(rows_of(docs))

    single = stages["near_duplicates"](spark, good, sf).cache()
    groups = brute_groups(rows_of(good))
    assert sorted(rows_of(single)) == sorted(k for k, (_, c) in groups.items() if k[0] == c)

    clean = stages["decontaminate"](spark, single, sf).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    bad = {k[0] for k in brute_contamination(rows_of(single), items) if k[-1]}
    assert sorted(rows_of(clean)) == sorted(r for r in rows_of(single) if r[0] not in bad)

    mixed = stages["mix"](spark, clean, sf).cache()
    assert mixed.columns == docs.columns
    times = Counter(rows_of(mixed))
    assert max(times.values()) <= 3 and not set(times) - set(rows_of(clean))
    words = lambda pairs: sum(len((t or "").split()) for _, t in pairs)
    assert abs(words(rows_of(mixed)) - words(rows_of(clean))) < 0.1 * words(rows_of(clean))

    final = stages["shard"](spark, mixed, sf)
    assert Counter(rows_of(final)) == times
    assert {"shard", "slot"} <= set(final.columns)


def test_stages_on_awkward_documents(spark, sf):
    docs = special_documents(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
        assert stage(spark, docs.limit(0), sf).count() == 0
        out.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    want = [tuple(dict(zip([c[0] for c in want.description], r, strict=True))[c] for c in columns) for r in want.fetchall()]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)
