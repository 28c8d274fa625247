"""Golden rows for operators that are expressions."""
from pyspark.sql import functions as F

from vistalake.functions.hashes import dhash, hamming
from vistalake.functions.vectors import l2_normalize
from vistalake.operators import duplicates, frames, organize, tagging, text
from vistalake.sources import catalog


def rows(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_keyframes(spark):
    got = rows(spark, [(9000, 30.0), (150, 30.0), (1, 30.0), (0, 0.0), (301, 29.97)], "n long, fps double", frames.keyframe_indices(F.col("n"), F.col("fps")))
    assert [r[0] for r in got] == [[300, 2250, 4500, 6750, 8700], [0, 37, 75, 112, 149], [0], [0, 0], [2, 75, 150, 225, 299]]


def test_seconds(spark):
    assert rows(spark, [(30.0, 15.0), (30.0, 0.0), (30.0, -1.0)], "n double, fps double", frames.seconds(F.col("n"), F.col("fps"))) == [(2.0,), (0.0,), (0.0,)]


def test_sequential_names(spark):
    data = [("a/img_01.jpg", "b/img_02.jpg", True), ("img_a_big.jpg", "img_b_small.jpg", False), ("abc.png", "abc_p1.png", True), ("xy1.png", "xz1.png", False), ("photo (1).jpg", "photo (2).jpg", True), ("ab.png", "ab1.png", False)]
    got = rows(spark, data, "a string, b string, want boolean", duplicates.is_sequential(F.col("a"), F.col("b")), "want")
    assert all(a == b for a, b in got), got


def test_dhash_and_hamming(spark):
    data = [(list(range(72)), "ffffffffffffffff"), ([5] * 72, "0000000000000000"), ([(i * 37) % 256 for i in range(72)], "fdf7df7efbefbffd"), ([1, 2], "")]
    assert [r[0] == r[1] for r in rows(spark, data, "g array<int>, want string", dhash(F.col("g")), "want")] == [True] * 4
    pairs = [("f" * 16, "0" * 16, 64), ("a" * 16, "a" * 16, 0), ("", "0" * 16, 999), ("8" + "0" * 15, "0" * 16, 1)]
    assert all(a == b for a, b in rows(spark, pairs, "a string, b string, want int", hamming(F.col("a"), F.col("b")), "want"))


def test_recommend(spark):
    side = "{0} int, {1} int, {2} long, {3} double"
    schema = ", ".join(f"width_{s} int, height_{s} int, file_size_{s} long, created_at_{s} double" for s in "ab")
    data = [(1920, 1080, 1, 1.0, 640, 480, 1, 1.0), (10, 10, 2000, 1.0, 10, 10, 1000, 1.0), (10, 10, 1000, 1.0, 10, 10, 2000, 1.0), (10, 10, 1000, 1.0, 10, 10, 1001, 2.0), (10, 10, 1000, 1.0, 10, 10, 1000, 1.0), (None, None, 3000, 9.0, None, None, 1000, 1.0)]
    assert side and [r[0]["action"] for r in rows(spark, data, schema, duplicates.recommend())] == ["keep_a", "keep_a", "keep_b", "keep_a", "keep_b", "keep_a"]


def test_merge_tags_and_categories(spark):
    assert rows(spark, [(["a"], ["a", "b", "b"], "photo"), (None, None, None)], "o array<string>, n array<string>, s string", frames.merge_tags(F.col("o"), F.col("n"), F.col("s"))) == [(["a", "b", "b", "photo"],), ([],)]
    assert rows(spark, [("re:zero / <a>|b?*",)], "c string", organize.safe_category(F.col("c"))) == [("re_zero _ _a__b__",)]


def test_majority_and_concat(spark):
    videos = spark.createDataFrame([(1,), (2,)], "video_id long")
    seen = spark.createDataFrame([(1, 0, "photo", ["a"]), (1, 1, "illustration", ["b", "a"])], "video_id long, frame_no int, style string, tags array<string>")
    assert dict(map(tuple, frames.majority(videos, seen).collect())) == {1: "photo", 2: "illustration"}
    assert frames.concat_frame_tags(seen, "tags").first()["tags"] == ["a", "b", "a"]


def test_normalize_keeps_zero(spark):
    assert rows(spark, [([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>", l2_normalize("v")) == [([0.0, 0.0],), ([0.6, 0.8],)]


def test_classify_edges(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    none = spark.createDataFrame([], "category string, ord int, embedding array<double>")
    assert tagging.classify(items, none).first()["category"] is None
    two = spark.createDataFrame([("b", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0])], "category string, ord int, embedding array<double>")
    assert tagging.classify(items, two).first()["category"] == "b"


def test_faces_fall_back_on_zero(spark):
    data = [(7, [[3.0, 4.0], [0.0, 2.0]], [(1.5,)])]
    got = catalog.explode_faces(spark.createDataFrame(data, "file_id long, face_vectors array<array<float>>, faces array<struct<timestamp:double>>")).orderBy("face_index").collect()
    assert [r["timestamp"] for r in got] == [1.5, 0.0]


def test_json_edges(spark):
    got = rows(spark, [(None,), ("",), ("{x",), ('["a"]',)], "c string", catalog.tags_from_json("c"))
    assert [r[0] for r in got] == [[], [], [], ["a"]]
    assert rows(spark, [(None,)], "s array<struct<start:double,end:double,text:string>>", catalog.segments_to_json("s")) == [(None,)]


def test_snippet_prefers_speech(spark):
    data = [(1, "video", 0, 0.5, "a Cat"), (1, "audio", 3, 7.5, "cat!"), (2, "video", 1, 2.0, "catalog"), (3, "audio", 0, 0.0, "dog")]
    segments = spark.createDataFrame(data, "id long, kind string, pos int, start_s double, text string")
    assert dict(map(tuple, text.snippets(segments, "CAT").collect())) == {1: "[Audio @7.5s] cat!", 2: "[Video @2.0s] catalog"}


def test_length_is_computed_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(l2_normalize("v").alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
