"""Tag bitmaps against the scanning operators: conditions, facets under filters, ids on both sides of zero, repeated and null tags."""
import random

import pytest
from pyspark.sql import functions as F

from vistalake.operators import listing
from vistalake.operators.tag_index import KINDS, TagIndex

SCHEMA = "id long, is_processed boolean, error_msg string, media_type string, created_at double, tags array<string>, character_tags array<string>, series_tags array<string>"


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(5)
    pick = lambda names: rng.choice([None, [], [rng.choice(names)], [rng.choice(names) for _ in range(3)]])
    ids = [0, 1, 7, -3, 32768, 32769, 65536, 65537, 10_000_000_000] + [rng.randrange(2, 200_000) for _ in range(300)]
    rows = [(i, rng.random() < 0.8, rng.choice([None, None, "bad"]), "image", 1.7e9, pick(["Sky", "sky blue", "SUN%", "ümläut"]), pick(["Alice W", "alice", "Bob"]), pick(["re:zero", "Wonder"])) for i in dict.fromkeys(ids)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(catalog):
    return TagIndex.build(catalog)


@pytest.mark.parametrize("kind,value", [("tag", "SK"), ("tag", "%"), ("tag", "Ü"), ("character", "alice"), ("series", "zero"), ("series", "none"), ("media_type", "picture"), ("year", "2023")])
def test_conditions(catalog, index, kind, value):
    want = {r["id"] for r in listing.match_condition(catalog, kind, value).select("id").collect()}
    found = index.match_condition(catalog, kind, value)
    assert {r["id"] for r in found.select("id").collect()} == want and found.columns == catalog.columns


def test_whole_tags(catalog, index):
    for kind, value in (("tag", "SKY"), ("character", "alice"), ("character", "alice%"), ("series", "RE:ZERO")):
        want = catalog.select("id", listing.has_tag(KINDS[kind], value).alias("x")).collect()
        assert {r["id"]: r["x"] for r in index.has_tag(catalog.select("id"), kind, value, "x").collect()} == {r["id"]: r["x"] for r in want}


def test_facets_under_filters(catalog, index):
    rows = lambda df: sorted(map(tuple, df.select("facet", "value", "n").collect()))
    assert rows(index.facets()) == rows(listing.facets(catalog))
    for conditions in ([("series", "Wonder")], [("tag", "sky"), ("character", "BOB")], [("tag", "nowhere")]):
        kept = catalog
        for kind, value in conditions:
            kept = kept.filter(listing.has_tag(KINDS[kind], value))
        assert rows(index.facets(conditions)) == rows(listing.facets(kept))
    kept = catalog.filter(F.exists("tags", lambda x: F.contains(F.lower(x), F.lit("sk"))))
    assert rows(index.facets([("tag", "SK")], whole=False)) == rows(listing.facets(kept))


def test_wrong_conditions_and_no_rows(catalog, index):
    for kind, value in (("tag", ""), ("colour", "red")):
        with pytest.raises(ValueError):
            index.match_condition(catalog, kind, value)
    empty = TagIndex.build(catalog.limit(0))
    assert empty.facets().count() == 0 and empty.match_condition(catalog, "tag", "sky").count() == 0
