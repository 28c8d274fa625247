"""Pages by key ranges and cursors against offsets, and ranks of large groups against a window."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vistalake.operators import listing, organize


@pytest.fixture(scope="module")
def media(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 29 == 0 else float(rng.choice([5, 5, 5, rng.randrange(400)])), f"/{i}.jpg", "image", True) for i in range(900)]
    return spark.createDataFrame(rows, "id long, created_at double, file_path string, media_type string, is_processed boolean").repartition(4)


ORDER = lambda: [F.desc_nulls_last("created_at"), F.asc("id")]


@pytest.mark.parametrize("most", [100_000, 40])
def test_any_page_equals_the_offset_form(media, most):
    """More than half of the rows share one key: `most` decides whether that key is counted by ties as well."""
    pages = listing.Pages(media, ranges=12, most=most)
    assert sum(r.n for r in pages.ranges) == 900 and len(pages.ranges) <= 24
    for offset in (0, 1, 49, 150, 333, 600, 860, 871, 895, 899, 900, 2000):
        want = listing.page(media, ORDER(), 25, offset).orderBy("rank").collect()
        assert pages.page(25, offset).orderBy("rank").collect() == want, offset


def test_a_page_sorts_a_share_of_the_rows(media):
    pages = listing.Pages(media, ranges=12, most=40)
    for offset in (10, 400, 800):
        where, skip = pages._spans(offset, 26)
        assert media.filter(where).count() < 300 and skip < 300


def test_cursor_walks_through_all_rows(media):
    pages, last, seen = listing.Pages(media, ranges=4), None, []
    for _ in range(12):
        rows = pages.after(100, last).orderBy("rank").collect()
        seen += [r["id"] for r in rows]
        if not rows or not rows[0]["has_more"]:
            break
        last = (rows[-1]["created_at"], rows[-1]["id"])
    assert seen == [r["id"] for r in media.orderBy(*ORDER()).collect()]
    first = listing.list_media(media, 60).collect()
    more = listing.list_media(media, 60, after=(first[19]["created_at"], first[19]["id"])).collect()
    assert more[:40] == first[20:]
    assert listing.Pages(media.limit(0)).page(10, 0).count() == 0


def test_ranks_of_one_name_for_all_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = spark.range(3000).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 10 == 0, F.concat(F.lit("n"), F.col("id") % 30)).otherwise("one").alias("name"), (F.col("id") % 2 == 0).alias("present"))
        got = organize.ranked(rows, ("name", "present"), "id", "turn", most=100)
        want = rows.withColumn("turn", F.row_number().over(Window.partitionBy("name", "present").orderBy("id")))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        items = spark.range(400).select("id", F.lit("/a/x.jpg").alias("file_path"), F.lit(7.0).alias("created_at"), F.lit(7.0).alias("modified_at"), F.lit(True).alias("present"))
        plan = organize.sort_plan(items, "/d", F.lit("c"), spark.createDataFrame([("/d/c/x_7.jpg",)], "path string"), most=50)
        assert {r["id"]: r["dest"] for r in plan.collect()} == {0: "/d/c/x.jpg"} | {i: f"/d/c/x_7_{i}.jpg" for i in range(1, 400)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
