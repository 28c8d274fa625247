"""Queries against DuckDB, and the pipeline against its stages, on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from vistalake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "benchmark", "labels"):
        con.sql(f"create view {name_of} as select * from '{SF}/{name_of}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_every_operator_has_its_query(spark):
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF).persist()
        assert left.columns == columns, name
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    text = {r["doc_id"]: r["text"] for r in left.select("doc_id", "text").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len(text) == len(set(text.values())) and not any(i in t for i in items for t in text.values())
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == ids


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.filter("n_chars > 500").orderBy("doc_id").limit(3).collect()
    odd = [(None, good[0]["text"]), (1, None), (2, ""), (3, good[1]["text"]), (3, good[1]["text"]), (4, good[1]["text"]), (5, good[2]["text"])]
    made = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    made.select(*docs.columns).write.parquet(str(tmp_path / "odd/documents.parquet"))
    made.limit(0).select(*docs.columns).write.parquet(str(tmp_path / "none/documents.parquet"))
    for name in ("odd", "none"):
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    left = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()]
    assert sorted(x for x in left if x is not None) in ([3, 5], [3], [5]) and left.count(3) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
