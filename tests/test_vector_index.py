"""The stored vector index against a scan: the same rows, replaced ids, ties, and a share of the files only."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalake.operators import similarity
from vistalake.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    m = np.repeat(rng.normal(size=(30, 16)), 40, axis=0) + rng.normal(scale=0.05, size=(1200, 16))
    m[100:140] = m[100]  # ties
    return m


def frame(spark, m, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")


def rows(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


def test_same_rows_from_few_cells(spark, points, tmp_path):
    vectors = frame(spark, points).unionByName(spark.createDataFrame([(9999, None)], "id long, embedding array<double>"))
    index = VectorIndex.build(vectors, str(tmp_path / "i"), cell_rows=40)
    opened, rng = [], np.random.default_rng(4)
    for query in (points[5], points[110], points[700] + 0.1, rng.normal(size=16), np.zeros(16)):
        for k in (1, 7, 60):
            got = index.top_k(query.tolist(), k)
            assert rows(got) == rows(similarity.top_k_similar(frame(spark, points), query.tolist(), k)), k
            opened.append(index.opened)
    assert len(index.cells()) == 30 and min(opened) <= 4 and np.mean(opened[:9]) <= 12
    assert index.top_k(points[0].tolist(), 5000).count() == 1200
    files = index.rows_of(index.cells()[:3]).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) == 3 and len(index.vectors().inputFiles()) >= 30


def test_appended_vectors_replace_their_id(spark, points, tmp_path):
    index = VectorIndex.build(frame(spark, points), str(tmp_path / "i"), cell_rows=100)
    new = spark.createDataFrame([(5, True, [-1.0] * 16, 1), (5, True, [3.0] + [0.0] * 15, 2), (2000, True, [2.0] + [0.0] * 15, 1), (6, False, [9.0] * 16, 1), (7, True, None, 1)], "id long, success boolean, embedding array<double>, seq long")
    index.append(new)
    query = [1.0] + [0.0] * 15
    assert sorted(i for i, s in rows(index.top_k(query, 1200)) if s == 1.0) == [5, 2000]
    assert index.vectors().count() == 1201 and index.vectors().groupBy("id").count().filter("count > 1").isEmpty()
    want = frame(spark, points).filter("id <> 5").unionByName(spark.createDataFrame([(5, query), (2000, query)], "id long, embedding array<double>"))
    assert rows(index.top_k(points[400].tolist(), 30)) == rows(similarity.top_k_similar(want, points[400].tolist(), 30))
    media = spark.createDataFrame([(2000, "/x")], "id long, file_path string")
    assert [r["file_path"] for r in index.top_k(query, 1200, media).collect()] == ["/x"]


def test_empty(spark, tmp_path):
    index = VectorIndex.build(frame(spark, np.zeros((0, 4))), str(tmp_path / "i"))
    assert index.top_k([1.0, 0.0, 0.0, 0.0]).count() == 0 and index.vectors().count() == 0
    index.add(frame(spark, np.ones((1, 4))))
    assert rows(index.top_k([1.0, 1.0, 1.0, 1.0])) == [(0, 2.0)]
    assert index.vectors().filter(F.size("embedding") == 4).count() == 1
