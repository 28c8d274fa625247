"""Tables in hash buckets: versions, merging and pruning against a dictionary; ingestion that opens only what it touches."""
import random

import pytest
from pyspark.sql import functions as F

from vistalake.sources import keyed
from vistalake.streaming import ingest


def test_versions_equal_a_dictionary(spark, tmp_path):
    """Random batches; keys with several rows and keys that go, as faces have; every batch run twice, as after a failure."""
    stored = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", buckets=4, compact=3, gone="v is null")
    rng, want = random.Random(4), {}
    for number in range(9):
        batch = {rng.randrange(12): [rng.randrange(100) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(1, 5))}
        rows = [(k, v) for k, values in batch.items() for v in (values or [None])]
        for _ in range(2):
            stored.put(spark.createDataFrame(rows, "k long, v long"), number)
        want |= batch
        got = sorted((r["k"], r["v"]) for r in stored.read(number + 1).collect())
        assert got == sorted((k, v) for k, values in want.items() for v in values), number
        for b in stored.touched(spark.createDataFrame([(k,) for k in want], "k long")):
            part = stored.read(number + 1, [b])
            assert part.filter(stored.bucket() != b).isEmpty()
    for found in stored.pieces(100).values():
        assert len(stored._counting(found)) <= 3 and sum(kind == "whole" for _, kind in found) <= 2  # the last whole version, and the one before


def test_batch_of_nothing_and_unfinished_commit(spark, tmp_path):
    stored, commits = keyed.KeyedTable(spark, str(tmp_path / "t"), "k"), keyed.Commits(spark, str(tmp_path / "c"))
    assert stored.read(5) is None and commits.last() is None
    stored.put(spark.createDataFrame([], "k long, v long"), 0)
    assert stored.read(5) is None
    for number in range(4):
        commits.put(number, 64, {"catalog": number * 10})
    (tmp_path / "c" / "batch-9").mkdir()  # not finished
    assert commits.numbers() == [2, 3] and commits.last()["tops"] == {"catalog": 30} and commits.last(3)["tops"] == {"catalog": 20}


@pytest.fixture
def ingested(spark, tmp_path):
    schema = "path string, file_hash string, v double"
    empty = spark.createDataFrame([], "id long, file_path string, file_hash string, is_processed boolean, error_msg string")

    def score(df):
        return df.select("file_path", "file_hash", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_msg"), F.lit(1).alias("seq"), F.array(F.col("v"), F.lit(1.0)).alias("embedding"))

    def add(rows, buckets=16):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.stream_ingest(spark, stream, str(tmp_path / "out"), str(tmp_path / "progress"), empty, score, buckets=buckets).awaitTermination()

    return add, str(tmp_path / "out")


def test_batch_of_one_file_opens_a_share_of_the_files(spark, ingested, monkeypatch):
    add, target = ingested
    add([(f"/l/{i}.jpg", "1", 1.0) for i in range(200)])
    opened, whole = [], keyed.KeyedTable._versions

    def watched(self, below, buckets):
        found = whole(self, below, buckets)
        opened.append((self.path, len(found.inputFiles()) if found is not None else 0))
        return found

    monkeypatch.setattr(keyed.KeyedTable, "_versions", watched)
    add([("/l/7.jpg", "2", 5.0), ("/l/new.jpg", "1", 2.0)])
    assert opened and max(n for _, n in opened) <= 2
    monkeypatch.undo()
    everything = ingest.state_table(spark, target, "catalog", 16)._versions(10, None)
    assert len(everything.inputFiles()) >= 16
    rows = {r["file_path"]: (r["id"], r["file_hash"]) for r in ingest.latest(spark, target).collect()}
    assert len(rows) == 201 and rows["/l/7.jpg"][1] == "2" and rows["/l/new.jpg"][0] == 201 and len({i for i, _ in rows.values()}) == 201
    some = ingest.latest(spark, target, "catalog", spark.createDataFrame([("/l/7.jpg",), ("/l/none.jpg",)], "file_path string"))
    assert [(r["file_path"], r["file_hash"]) for r in some.collect()] == [("/l/7.jpg", "2")]
    assert ingest.latest(spark, target, "vectors").count() == 201


def test_other_number_of_buckets_is_refused(ingested):
    add, _ = ingested
    add([("/a.jpg", "1", 1.0)])
    with pytest.raises(Exception, match="16 buckets"):
        add([("/b.jpg", "1", 1.0)], buckets=8)
