"""Continuous ingestion of manifests into a catalog, its vectors and its faces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vistalake.sources.catalog import explode_faces, inventory, latest_vectors, pending, upsert_catalog, with_media_type, with_new_ids
from vistalake.sources.keyed import BUCKETS, COMPACT, Commits, KeyedTable, highest
from vistalake.sources.tables import discard, written

#: A row of the newest version replaces the older rows of its key; all face rows of a file go together.
KEYS = {"catalog": "file_path", "vectors": "id", "faces": "file_id"}


def state_table(spark: SparkSession, path: str, table: str, buckets: int = BUCKETS, compact: int = COMPACT) -> KeyedTable:
    return KeyedTable(spark, f"{path}/{table}", KEYS[table], buckets, compact, "face_index is null" if table == "faces" else None)


def latest(spark: SparkSession, path: str, table: str = "catalog", keys: DataFrame | None = None) -> DataFrame | None:
    """The newest state of a table of stream_ingest, if there is one; with `keys` (a table with the key's column) only the rows of these, from their buckets alone. Batches that aren't committed don't count."""
    done = Commits(spark, f"{path}/commits").last()
    if done is None:
        return None
    stored = state_table(spark, path, table, done["buckets"])
    if keys is None:
        return stored.read(done["batch"] + 1)
    found = stored.read(done["batch"] + 1, stored.touched(keys))
    return None if found is None else found.join(keys.select(KEYS[table]).distinct().hint("merge"), KEYS[table], "left_semi")


def stream_ingest(spark: SparkSession, source: DataFrame, catalog_path: str, checkpoint: str, empty: DataFrame, score: Callable[[DataFrame], DataFrame], compact: int = COMPACT, buckets: int = BUCKETS) -> StreamingQuery:
    """Each micro-batch of a manifest stream: inventory, skip what is processed, score, upsert.

    `score` turns manifest rows (path, ..., media_type, file_hash) into results (file_path, file_hash,
    success, seq, ...); `empty` is a catalog without rows. Where the catalog has ids, results may also
    have embedding, and face_vectors with faces: a successful file's vector and faces replace its old
    ones, a failed one's stay. Tables are kept in `buckets` hash buckets of their key (vistalake.sources.keyed):
    a batch reads and joins the catalog's buckets of its own paths, takes the highest id from the last
    commit, and writes only the rows that it changes. It is worked out from the versions below it, so a batch that is run
    again after a failure writes the same rows; the commit comes last and makes it count.
    """
    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        commits = Commits(session, f"{catalog_path}/commits")
        done = commits.last(number)
        if done is not None and done["buckets"] != buckets:
            raise ValueError(f"the tables have {done['buckets']} buckets, not {buckets}")
        stored = {name: state_table(session, catalog_path, name, buckets, compact) for name in KEYS}
        tops = dict(done["tops"]) if done else {}
        found = with_media_type(inventory(rows)).withColumn("file_path", F.col("path"))
        before = stored["catalog"].read(number, stored["catalog"].touched(found))
        catalog = before if before is not None else empty
        results = written(score(pending(found, catalog)), "scored")
        known = catalog.join(results.select("file_path").distinct().hint("merge"), "file_path", "left_semi").select(*catalog.columns)
        changed = written(upsert_catalog(known, results, tops.get("catalog", 0)), "changed")
        if "id" not in catalog.columns:
            stored["catalog"].put(changed, number)
            commits.put(number, buckets, tops)
            discard(results, changed)
            return
        mine = results.join(changed.select("id", "file_path").hint("merge"), "file_path")
        if "embedding" in results.columns:
            stored["vectors"].put(latest_vectors(mine), number)
        if "face_vectors" in results.columns:
            last = mine.filter("success").groupBy(F.col("id").alias("file_id")).agg(F.max_by(F.struct("face_vectors", "faces"), "seq").alias("r")).select("file_id", "r.*")
            faces = explode_faces(last)
            gone = last.filter(F.coalesce(F.size("face_vectors"), F.lit(0)) <= 0).select("file_id", F.lit(-1).cast("bigint").alias("id"))  # no face replaces those before
            new = written(faces.withColumn("id", F.lit(None).cast("bigint")).withColumn("_key", F.struct("file_id", "face_index")), "new-faces")
            numbered = written(with_new_ids(new, "_key", top=tops.get("faces", 0)).drop("_key").unionByName(gone, allowMissingColumns=True), "numbered-faces")
            stored["faces"].put(numbered, number)
            tops["faces"] = highest(tops, "faces", numbered)
            discard(new, numbered)
        stored["catalog"].put(changed, number)
        tops["catalog"] = highest(tops, "catalog", changed)
        commits.put(number, buckets, tops)
        discard(results, changed)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
