"""Anchors as matrices and sums of vectors, against plain NumPy: ties, blocks of anchors, nulls, groups of any size."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalake.operators import frames, similarity, tagging


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    x, a = rng.normal(size=(300, 20)), rng.normal(size=(70, 20))
    a[50:60] = a[:10]  # equal anchors, far apart
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, embedding array<double>")
    anchors = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(a)] + [(99, "none", None)], "tag_idx int, tag string, embedding array<double>")
    return x, a, vectors, anchors


def by_hand(x, a, k):
    scores = np.array([[float((v * w).sum()) for w in a] for v in x])
    return {i: [(int(j), scores[i, j]) for j in np.lexsort((np.arange(len(a)), -scores[i]))[:k]] for i in range(len(x))}


@pytest.mark.parametrize("at_once", [1000, 25, 3])
def test_k_best_anchors(tables, at_once):
    x, a, vectors, anchors = tables
    found = similarity.nearest_anchors(vectors, anchors, "tag_idx", 6, at_once=at_once)
    got = {r["id"]: [(f["tag_idx"], f["score"]) for f in r["found"]] for r in found.collect()}
    want = by_hand(x, a, 6) | {900: []}
    assert {i: [j for j, _ in f] for i, f in got.items()} == {i: [j for j, _ in f] for i, f in want.items()}
    assert all(np.allclose([s for _, s in got[i]], [s for _, s in want[i]]) for i in got)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_tags_and_classes(spark, tables):
    x, a, vectors, anchors = tables
    tags = {r["id"]: r["tags"] for r in tagging.suggest_tags(vectors, anchors, 4, 2.0).collect()}
    assert tags == {i: [f"t{j}" for j, s in f if s >= 2.0] for i, f in by_hand(x, a, 4).items()} | {900: []}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    classes = anchors.select(F.concat(F.lit("c"), "tag_idx").alias("category"), (100 - F.col("tag_idx")).alias("ord"), "embedding").filter("category <> 'c99'")
    got = {r["id"]: r["category"] for r in tagging.classify(vectors, classes, 0.5).collect()}
    scores = by_hand(unit(x), a[::-1], 1)
    assert got == {i: f"c{69 - f[0][0]}" if f[0][1] >= 0.5 else None for i, f in scores.items()} | {900: None}
    assert {r["category"] for r in tagging.classify(vectors, classes.limit(0)).collect()} == {None}
    assert {tuple(r["tags"]) for r in tagging.suggest_tags(vectors, anchors.limit(0)).collect()} == {()}
    assert tagging.suggest_tags(vectors.limit(0), anchors).count() == 0


@pytest.mark.parametrize("unit", [False, True])
def test_sums_of_vectors(spark, tables, unit, monkeypatch):
    x, _, vectors, _ = tables
    monkeypatch.setattr(tagging, "GROUPS", 3)
    for group in (F.lit("one"), F.concat(F.lit("g"), F.col("id") % 7), F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))):
        grouped = vectors.repartition(5).withColumn("g", group)
        rows = {r["id"]: r["g"] for r in grouped.select("id", "g").collect() if r["g"] is not None and r["id"] != 900}
        m = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
        want = {g: np.mean([m[i] for i in rows if rows[i] == g], axis=0) for g in set(rows.values())}
        got = {r["g"]: np.array(r["embedding"]) for r in tagging.mean_vectors(grouped, "g", unit).collect()}
        assert set(got) == set(want) and all(np.allclose(got[g], want[g] / np.linalg.norm(want[g])) for g in want)
    assert tagging.mean_vectors(vectors.limit(0).withColumn("g", F.lit(1)), "g").count() == 0


def test_one_row_for_each_group_and_task(tables):
    """What is shuffled first is a sum for each group that a task meets, of long and float vectors alike."""
    _, _, vectors, _ = tables
    grouped = vectors.filter("id < 300").repartition(4).withColumn("group", F.col("id") % 3).select("group", F.col("embedding").cast("array<float>").alias("embedding"))
    sums = grouped.mapInArrow(tagging._added(), "group long, n long, total array<double>").collect()
    assert len(sums) == 12 and sum(r["n"] for r in sums) == 300


def test_pooled_frames(spark, tables):
    x, _, vectors, _ = tables
    clips = vectors.withColumn("video_id", F.floor(F.col("id") / 10)).withColumn("frame_no", F.col("id") % 10)
    got = {r["video_id"]: r["embedding"] for r in frames.pool_frames(spark.range(40).withColumnRenamed("id", "video_id"), clips, 20).collect()}
    assert np.allclose(got[3], x[30:40].mean(0) / np.linalg.norm(x[30:40].mean(0))) and got[35] == [0.0] * 20 and len(got) == 40


def test_more_groups_than_a_task_holds(spark):
    rng, groups = np.random.default_rng(8), 2 * tagging.GROUPS + 500
    x, by = rng.normal(size=(3 * groups, 4)), np.tile(np.arange(groups), 3)
    vectors = spark.createDataFrame([(int(g), v.tolist()) for g, v in zip(by, x)], "g long, embedding array<double>").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # all groups' sums come to one task
    try:
        got = [(r["g"], r["embedding"]) for r in tagging.mean_vectors(vectors, "g").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = x.reshape(3, groups, 4).sum(axis=0)
    assert sorted(g for g, _ in got) == list(range(groups))
    np.testing.assert_allclose(np.array([v for _, v in sorted(got)]), want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-9)
