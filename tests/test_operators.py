"""Operators with joins, rounds or state against plain Python."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalake.operators import clustering, listing, organize, scoring, similarity
from vistalake.sources import catalog, tables


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def jittered():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    return np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.02, 0.1, 0.3)])


def test_block_pairs_equal_native_and_numpy(spark, jittered):
    df = frame(spark, jittered)
    unit = jittered / np.linalg.norm(jittered, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if 0.9 < s[i, j] <= 0.9999}
    for f in (similarity.similar_pairs, similarity.similar_pairs_native):
        assert {(r["id_a"], r["id_b"]) for r in f(df, 0.9).collect()} == want


def test_top_k_batch(spark, jittered):
    df = frame(spark, jittered)
    got = similarity.top_k_batch(df, df.select(F.col("id").alias("query_id"), "embedding"), 3, rows=7).collect()
    unit = jittered / np.linalg.norm(jittered, axis=1, keepdims=True)
    s = unit @ jittered.T
    for q in range(len(s)):
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == list(np.lexsort((np.arange(len(s)), -s[q]))[:3])


def reference_dbscan(points, eps, least):
    d = np.linalg.norm(points[:, None] - points[None], axis=2) <= eps
    core = d.sum(axis=1) >= least
    label, n = np.full(len(points), -1), 0
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                k = todo.pop()
                if label[k] < 0:
                    label[k] = n
                    todo += [j for j in np.flatnonzero(d[k]) if core[j] and label[j] < 0]
            n += 1
    for i in range(len(points)):
        if not core[i] and (d[i] & core).any():
            label[i] = label[d[i] & core].min()
    return label


@pytest.mark.parametrize("seed", [0, 1])
def test_dbscan(spark, seed):
    rng = np.random.default_rng(seed)
    angle = np.concatenate([rng.normal(c, 0.1, 12) for c in (0, 1.2, 2.5)] + [rng.uniform(0, 6.28, 10)])
    points = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    got = {r["id"]: r["cluster_id"] for r in clustering.dbscan(frame(spark, points), 0.12, 4).collect()}
    assert [got[i] for i in range(len(points))] == reference_dbscan(points, 0.12, 4).tolist()


def test_dbscan_two_groups_and_empty(spark):
    rng = np.random.default_rng(3)
    a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 64)))
    points = np.concatenate([x + rng.normal(scale=0.005, size=(5, 64)) for x in (a, b)])
    assert clustering.cluster_summary(clustering.dbscan(frame(spark, points), 0.8, 2)).first()["n_clusters"] == 2
    assert clustering.cluster_summary(clustering.dbscan(frame(spark, []), 0.8, 2)).first()["n_clusters"] == 0


def test_upsert_columns(spark):
    schema = "id long, file_path string, file_hash string, file_size long, created_at double, is_processed boolean, error_msg string, rating int"
    old = spark.createDataFrame([(1, "a", "h", None, 1.0, False, "bad", 3), (2, "b", "h", 5, 1.0, True, None, 0)], schema)
    batch = spark.createDataFrame([("a", "n", 9, 2.0, True, None, 1), ("c", "x", 7, 3.0, False, "e", 1), ("c", "y", 8, 4.0, True, None, 2)], "file_path string, file_hash string, file_size long, created_at double, success boolean, error_msg string, seq int")
    got = {r["file_path"]: r for r in catalog.upsert_catalog(old, batch).collect()}
    assert tuple(got["a"]) == (1, "a", "n", None, 1.0, True, None, 3)
    assert tuple(got["b"]) == (2, "b", "h", 5, 1.0, True, None, 0)
    assert tuple(got["c"]) == (3, "c", "y", 7, 3.0, True, None, 0)


def test_pending_retries_failures(spark):
    old = spark.createDataFrame([("a", "1", True), ("b", "1", False), ("c", "0", True)], "file_path string, file_hash string, is_processed boolean")
    new = spark.createDataFrame([(p, "1") for p in "abcd"], "file_path string, file_hash string")
    assert {r[0] for r in catalog.pending(new, old).select("file_path").collect()} == {"b", "c", "d"}
    assert catalog.pending(new, old, force=True).count() == 4


def test_conditions_reject_nonsense(spark):
    rows = spark.createDataFrame([], catalog.MEDIA_SCHEMA)
    for kind, value in (("year", "20x"), ("tag", ""), ("colour", "red")):
        with pytest.raises(ValueError):
            listing.match_condition(rows, kind, value)


def test_third_name_gets_a_number(spark):
    items = spark.createDataFrame([(i, f"/x{i}/f.jpg", 7.0, None, True) for i in range(3)] + [(3, "/y/f.jpg", 7.0, None, False)], "id long, file_path string, created_at double, modified_at double, present boolean")
    plan = organize.sort_plan(items, "/d", F.lit("c"), spark.createDataFrame([], "path string"))
    assert [r["dest"] for r in plan.orderBy("id").collect()] == ["/d/c/f.jpg", "/d/c/f_7.jpg", "/d/c/f_7_1.jpg", None]
    assert organize.undo_plan(plan.withColumn("operation", F.lit("dry_run"))).count() == 0


def test_scoring_isolates_failures(spark):
    def make():
        def model(part):
            if (part["id"] == 3).any():
                raise RuntimeError("three")
            return part[["id"]].assign(y=part["id"] * 2.0)

        return model

    out = scoring.score_batches(spark.range(8), make, "id long, y double", batch_size=4)
    good, bad = scoring.with_outcome(out)
    assert {r["id"]: r["y"] for r in good.collect()} == {i: i * 2.0 for i in range(8) if i != 3}
    assert [(r["id"], r["y"], r["error_msg"]) for r in bad.collect()] == [(3, None, "three")]


def test_listing_of_files(spark, tmp_path):
    for name in ("a.JPG", "b.txt", ".hid/c.jpg", "skip/d.jpg", "sub/e.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 9000)
    found = catalog.inventory(catalog.list_files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:/*", "/")), exclude=(str(tmp_path / "skip"),))
    assert {r["path"].rsplit("/", 1)[1] for r in found.collect()} == {"a.JPG", "e.mp4"}


def test_stream_twice_changes_nothing(spark, tmp_path):
    from vistalake.streaming.ingest import latest, stream_ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(f"/l/{i}.jpg", f"h{i}") for i in range(6)], "path string, file_hash string")
    empty = spark.createDataFrame([], "file_path string, file_hash string, is_processed boolean, error_msg string")
    score = lambda df: df.select("file_path", "file_hash", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_msg"), F.lit(1).alias("seq"))
    seen = []
    for _ in range(2):
        rows.repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_ingest(spark, stream, target, str(tmp_path / "progress"), empty, score).awaitTermination()
        seen.append(sorted(map(tuple, latest(spark, target).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 6


def test_save_load_and_categories(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "category string, x int")
    tables.save(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.load(spark, str(tmp_path / "t")).collect())) == [("a", 1), ("b", 2)]
    tables.write_by_category(df, str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"category=a", "category=b"}


def test_stream_replaces_vectors_and_faces(spark, tmp_path):
    from vistalake.streaming.ingest import latest, stream_ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, file_hash string, v double, n int, success boolean"
    empty = spark.createDataFrame([], "id long, file_path string, file_hash string, is_processed boolean, error_msg string")

    def score(df):
        vector = F.array(F.col("v"), F.lit(1.0))
        return df.select("file_path", "file_hash", "success", F.lit(None).cast("string").alias("error_msg"), F.lit(1).alias("seq"), vector.alias("embedding"),
                         F.array_repeat(vector, F.col("n")).alias("face_vectors"), F.array().cast("array<struct<timestamp:double>>").alias("faces"))

    batches = [[("/a.jpg", "1", 1.0, 2, True), ("/b.jpg", "1", 1.0, 1, True)], [("/a.jpg", "2", 0.0, 1, True), ("/c.jpg", "1", 1.0, 3, True)],
               [("/b.jpg", "2", 0.0, 0, True), ("/c.jpg", "2", 0.0, 1, False)], [("/b.jpg", "2", 5.0, 5, True)], [("/c.jpg", "2", 0.0, 1, True)]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream_ingest(spark, spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "progress"), empty, score, compact=2).awaitTermination()
        ids = {r["id"]: r["file_path"] for r in latest(spark, target).collect()}
        first = {ids[r["id"]]: r["embedding"][0] for r in latest(spark, target, "vectors").collect()}
        faces = latest(spark, target, "faces").collect()
        assert len({r["id"] for r in faces}) == len(faces)
        seen.append((sorted(ids.values()), {k: round(v, 3) for k, v in first.items()}, sorted((ids[r["file_id"]], r["face_index"]) for r in faces)))
    half = 0.707
    assert seen[0] == (["/a.jpg", "/b.jpg"], {"/a.jpg": half, "/b.jpg": half}, [("/a.jpg", 0), ("/a.jpg", 1), ("/b.jpg", 0)])
    assert seen[1][1:] == ({"/a.jpg": 0.0, "/b.jpg": half, "/c.jpg": half}, [("/a.jpg", 0), ("/b.jpg", 0)] + [("/c.jpg", k) for k in range(3)])
    assert seen[2][1:] == ({"/a.jpg": 0.0, "/b.jpg": 0.0, "/c.jpg": half}, [("/a.jpg", 0)] + [("/c.jpg", k) for k in range(3)])
    assert seen[3] == seen[2]  # processed under this hash
    assert seen[4][1:] == ({"/a.jpg": 0.0, "/b.jpg": 0.0, "/c.jpg": 0.0}, [("/a.jpg", 0), ("/c.jpg", 0)])
    assert {p.name for p in (tmp_path / "out" / "commits").iterdir()} == {"batch-3", "batch-4"}


@pytest.mark.parametrize("rows", [8, 64])
def test_approximate_pairs(spark, rows):
    rng = np.random.default_rng(9)
    base = np.concatenate([rng.normal(size=(40, 24)), np.repeat(rng.normal(size=(1, 24)), 40, axis=0)])  # half are one group
    m = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0.01, 0.05, 0.2)])
    df = frame(spark, m)
    exact = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.similar_pairs(df).collect()}
    near = similarity.similar_pairs_approximate(df, rows=rows).collect()
    found = {(r["id_a"], r["id_b"]): r["similarity"] for r in near}
    assert len(found) == len(near) and all(abs(exact[k] - v) < 1e-9 for k, v in found.items())
    assert len(found) >= 0.97 * len(exact) > 0
    assert similarity.similar_pairs_approximate(df.limit(0)).count() == 0


def test_filters_before_and_after_ranking(spark):
    media = spark.createDataFrame([(i, f"/{i}", "image" if i % 2 else "video", ["x"], ["s"] if i % 3 else []) for i in range(12)], "id long, file_path string, media_type string, character_tags array<string>, series_tags array<string>")
    vecs = frame(spark, [[12 - i, i] for i in range(12)])
    segments = spark.createDataFrame([(4, "audio", 0, 1.0, "a word")], "id long, kind string, pos long, start_s double, text string")
    run = lambda **o: {r["id"]: r["snippet"] for r in similarity.filtered_search(media, vecs, segments, "word", [1.0, 0.0], 4, **o).collect()}
    assert set(run(media_type="image")) == {1} and set(run(media_type="image", pre_filter=True)) == {1, 3, 5, 7}
    assert run(media_type="video") == {4: "[Audio @1.0s] a word", 0: None, 2: None}
    assert set(run(media_type="video", series="s", pre_filter=True)) == {2, 4, 8, 10}
