"""The registered queries: those with SQL against it, the others on held-out accuracy and their own promises."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tableproof.fixtures import TABLES, load
from tableproof.llm import queries as Q
from tableproof.llm.common import is_held_out

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = Q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(Q.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = Q.op1_toxicity(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    caught = sum(r["predicted"] for r in rows if r["toxic"] == 1) / sum(r["toxic"] for r in rows)
    assert right / len(rows) > 0.95 and caught > 0.85
    assert all(0 <= r["score"] <= 1 and is_held_out(r["doc_id"]) for r in rows)


def test_languages_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = Q.op7_language(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert whole and all(r["round_trip"] for r in whole)
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert first.columns == docs.columns
    good = load(spark, sf_dir, "labels").filter("quality = 1").join(docs.filter("length(text) > 200"), "doc_id").select("doc_id").distinct()
    lost = good.join(first, "doc_id", "left_anti").count()
    assert lost <= 0.02 * good.count()
    third = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir)
    assert third.select("text").distinct().count() == third.count()
    assert {r["doc_id"] for r in whole} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_takes_an_empty_table(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).isEmpty(), name
