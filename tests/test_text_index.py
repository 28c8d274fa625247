"""The trigram index against a scan: random substrings, Unicode, short and absent queries, replaced ids, and what a query opens."""
import random

import pytest
from pyspark.sql import functions as F

from vistalake.operators import similarity, text
from vistalake.operators.text_index import SegmentIndex, grams_of

SCHEMA = "id long, kind string, pos long, start_s double, text string"
ALPHABET = "abcABC äÖß😀İσΣ%_\\"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(n)))
    out = [(i // 3, rng.choice(["audio", "video"]), i % 3, i * 0.5, word(60)) for i in range(300)]
    return out + [(500, "audio", 0, 1.0, None), (501, "audio", 0, 1.0, ""), (502, "video", 0, 1.0, "ab"), (503, "video", 0, 1.0, "x" * 50_000 + " needle"), (None, "audio", 0, 1.0, "abc abc")]


@pytest.fixture(scope="module")
def segments(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def index(segments, tmp_path_factory):
    return SegmentIndex.build(segments, str(tmp_path_factory.mktemp("index") / "i"))


def test_grams():
    assert len(grams_of("abcabc")) == 3 and len(grams_of("ab")) == len(grams_of(None)) == 0
    assert len(set(grams_of("a😀b").tolist()) | set(grams_of("a😁b").tolist())) == 2


def test_matching_equals_a_scan(segments, index, rows):
    rng = random.Random(2)
    texts = [r[4] for r in rows if r[4] and len(r[4]) > 8]
    queries = ["", "a", "b%", "needle", "xxx", "not there", "ß", "ABC", "Äö", "_\\"]
    for _ in range(14):
        t = rng.choice(texts)
        low = rng.randrange(len(t) - 5)
        queries.append(rng.choice([str, str.upper, str.lower])(t[low : low + rng.randrange(2, 6)]))
    for query in queries:
        want = sorted(map(tuple, segments.filter(text.contains_text(F.col("text"), query)).collect()), key=str)
        assert sorted(map(tuple, index.matching(query).collect()), key=str) == want, query


def test_hits_snippets_and_search_through_the_index(spark, segments, index):
    media = spark.createDataFrame([(i, f"/{i}", "video" if i % 2 else "image") for i in range(100)], "id long, file_path string, media_type string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "id long, embedding array<double>")
    for query in ("ab", "abc", "c a", "zzzz"):
        assert text.text_hits(media, index.matching(query), query).collect() == text.text_hits(media, segments, query).collect()
        both = [sorted(map(tuple, similarity.hybrid_search(media, vectors, s, query, [1.0, 0.0], 12).collect()), key=str) for s in (index, segments)]
        assert both[0] == both[1]


def test_later_segments_replace_those_of_their_id(spark, segments, tmp_path):
    index = SegmentIndex.build(segments, str(tmp_path / "i"))
    index.add(spark.createDataFrame([(0, "audio", 0, 0.0, "a brand new text"), (900, "audio", 0, 0.0, "another new text")], SCHEMA))
    index.add(spark.createDataFrame([(900, "audio", 0, 0.0, "changed")], SCHEMA))
    assert sorted(r["id"] for r in index.matching("NEW TEXT").collect()) == [0]
    assert sorted(r["id"] for r in index.matching("chang").collect()) == [900]
    assert index.matching("").filter("id = 0").count() == 1 and index.segments().filter("id = 900").count() == 1
    assert SegmentIndex(spark, str(tmp_path / "none")).matching("abc").count() == 0
    empty = SegmentIndex.build(segments.limit(0), str(tmp_path / "empty"))
    assert empty.matching("abc").count() == empty.matching("a").count() == 0


def test_a_query_reads_its_postings_only(spark, index):
    """The filter on trigrams reaches the scan."""
    plan = index.candidates("needle", 0)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
    assert index.candidates("needle", 0).count() == 1
