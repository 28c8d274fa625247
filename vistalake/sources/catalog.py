"""Inventory, the catalog table and its upserts, side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.functions.vectors import l2_normalize
from vistalake.sources.tables import written

# Extensions of the media types.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm")
LABELLED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")

SEGMENT = "struct<start:double,end:double,text:string>"
FRAME_TEXT = "struct<timestamp:double,text:string>"
MEDIA_SCHEMA = (
    "id bigint, file_path string, file_hash string, file_size bigint, media_type string, created_at double, modified_at double, "
    "width int, height int, duration double, fps double, is_processed boolean, error_msg string, tags array<string>, "
    f"character_tags array<string>, series_tags array<string>, rating int, audio_transcription array<{SEGMENT}>, frame_descriptions array<{FRAME_TEXT}>")
#: What an upsert leaves as it was and what it replaces.
STATIC = ("file_size", "media_type", "created_at", "width", "height", "duration")
UPDATED = ("file_hash", "is_processed", "error_msg", "modified_at", "tags", "character_tags", "series_tags", "audio_transcription", "frame_descriptions")


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot; '' without one. Dots that a name begins with start no extension."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Manifest (path, length, modified_at) of all files under `root`, contents unread. Spark's listing hides names that begin with `_` or `.`: see folders.list_folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.unix_micros("modificationTime").alias("modified_us"), (F.unix_micros("modificationTime") / 1e6).alias("modified_at"))


def inventory(manifest: DataFrame, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] = IMAGE_EXTENSIONS + VIDEO_EXTENSIONS, root: str = "") -> DataFrame:
    """Rows of `manifest` (path, ...) with an allowed extension, outside dot-directories below `root` and excluded directories."""
    below = F.substr("path", F.lit(len(root.rstrip("/")) + 1)) if root else F.col("path")
    out = manifest.filter(extension("path").isin(*[e.lower() for e in extensions]) & ~below.rlike(r"/\.[^/]*/"))
    for directory in exclude:
        out = out.filter(~F.col("path").startswith(directory.rstrip("/") + "/"))
    return out


def with_media_type(df: DataFrame, path: str = "path") -> DataFrame:
    """Image or video by extension; anything else counts as image."""
    return df.withColumn("media_type", F.when(extension(path).isin(*VIDEO_EXTENSIONS), "video").otherwise("image"))


def with_fingerprint(df: DataFrame, chunk: int = 8192) -> DataFrame:
    """S3: md5 over length, modification time (microseconds) and the first and last 8 KiB.

    Takes `content`, or `head` and `tail` cut beforehand for large files; the path's md5 where these are null.
    """
    if "content" in df.columns:
        ends = F.substring("content", 1, chunk), F.substring("content", -chunk, chunk)
    else:
        ends = F.col("head"), F.col("tail")
    parts = [F.col("length").cast("string"), F.col("modified_us").cast("string"), *[F.lower(F.hex(x)) for x in ends]]
    return df.withColumn("file_hash", F.coalesce(F.md5(F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2], F.lit("_"), parts[3])), F.md5("path")))


def to_media_items(df: DataFrame) -> DataFrame:
    """Catalog columns of an inventory; created_at falls back on modified_at."""
    created = F.coalesce("created_at", "modified_at") if "created_at" in df.columns else F.col("modified_at")
    return df.select(
        F.col("path").alias("file_path"), "file_hash", F.col("length").cast("bigint").alias("file_size"), "media_type",
        created.alias("created_at"), "modified_at", F.lit(False).alias("is_processed"))


def pending(found: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """Rows that the catalog doesn't have processed under the same path and hash."""
    if force:
        return found
    return found.join(catalog.filter("is_processed").select("file_path", "file_hash").hint("merge"), ["file_path", "file_hash"], "left_anti")


def upsert_catalog(catalog: DataFrame, results: DataFrame, top: int | None = None) -> DataFrame:
    """The catalog after a batch of results (success, seq to order repeated paths, and catalog columns).

    New paths get all columns, statics from the path's first result and the rest from its last. Known
    paths keep STATIC, id and rating and get UPDATED. New ids follow the highest one, or `top` where
    `catalog` is a part of a larger one.
    """
    results = results.withColumn("is_processed", F.col("success"))
    static, updated = [c for c in STATIC if c in results.columns], [c for c in UPDATED if c in results.columns and c in catalog.columns]
    batch = results.groupBy("file_path").agg(
        F.min_by(F.struct(F.lit(1), *static), "seq").alias("first"), F.max_by(F.struct(*updated), "seq").alias("last"))
    old = catalog.withColumn("known", F.lit(True))
    both = old.join(batch.hint("merge"), "file_path", "full_outer")
    known, given = F.col("known").isNotNull(), F.col("last").isNotNull()
    columns = []
    for c in catalog.columns:
        if c in static:
            value = F.when(known, F.col(c)).otherwise(F.col(f"first.{c}"))
        elif c in updated:
            value = F.when(given, F.col(f"last.{c}")).otherwise(F.col(c))
        elif c == "rating":
            value = F.coalesce(F.col(c), F.lit(0))
        else:
            value = F.col(c)
        columns.append(value.alias(c))
    merged = both.select(*columns)
    return with_new_ids(written(merged, "merged"), "file_path", top=top) if "id" in catalog.columns else merged


def with_new_ids(df: DataFrame, order: str, parts: int = 256, top: int | None = None) -> DataFrame:
    """Null ids become `top`, or else the highest id, plus a gapless rank by `order` within hash parts, so that no single task ranks all new rows."""
    new = df.filter("id is null").drop("id").withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
    top = df.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(top or 0)).alias("_top"))
    sizes = new.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # 256 rows
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    given = new.withColumn("_rank", rank).join(F.broadcast(starts), "_part").join(F.broadcast(top))  # one row
    given = given.withColumn("id", F.col("_top") + F.col("_start") + F.col("_rank"))
    return df.filter("id is not null").unionByName(given.select(*df.columns))


def evolve_schema(df: DataFrame, target: str | T.StructType = MEDIA_SCHEMA) -> DataFrame:
    """Columns that `target` has and `df` lacks are added as null; rows and other columns stay."""
    return df.unionByName(df.sparkSession.createDataFrame([], target), allowMissingColumns=True)


def latest_vectors(results: DataFrame) -> DataFrame:
    """Normalised vectors of successful results(id, success, embedding, seq), the latest of an id."""
    new = results.filter(F.col("success") & F.col("embedding").isNotNull()).groupBy("id").agg(F.max_by("embedding", "seq").alias("embedding"))
    return new.select("id", l2_normalize("embedding").alias("embedding"))


def append_vectors(index: DataFrame, results: DataFrame) -> DataFrame:
    """index(id, embedding) plus the normalised vectors of successful results(id, success, embedding, seq); the latest of an id wins."""
    new = latest_vectors(results)
    kept = index.select("id", F.col("embedding").cast("array<double>").alias("embedding")).join(new.select("id").hint("merge"), "id", "left_anti")
    return kept.unionByName(new)


def explode_faces(results: DataFrame) -> DataFrame:
    """A row for each face vector of results(file_id, face_vectors, faces): index, timestamp (0.0 where there is no face record), normalised vector."""
    rows = results.select("file_id", "faces", F.posexplode("face_vectors").alias("face_index", "vector"))
    at = F.coalesce(F.get("faces", F.col("face_index"))["timestamp"], F.lit(0.0))
    return rows.select("file_id", "face_index", at.alias("timestamp"), l2_normalize("vector").alias("embedding"), F.lit(-1).alias("cluster_id"))


def replace_faces(faces: DataFrame, new: DataFrame) -> DataFrame:
    """faces(id, file_id, ...) with the rows of `new` (explode_faces) in place of their files' old ones; new rows get the next free ids."""
    kept = faces.join(new.select("file_id").distinct().hint("merge"), "file_id", "left_anti")
    both = kept.unionByName(new.withColumn("id", F.lit(None).cast("bigint")), allowMissingColumns=True).withColumn("_key", F.struct("file_id", "face_index"))
    top = faces.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return with_new_ids(written(both, "faces"), "_key", top=top).drop("_key")


def tags_from_json(c: Column | str) -> Column:
    """JSON list to array; null, empty and invalid text give an empty one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def tags_to_json(c: Column | str) -> Column:
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def segments_from_json(c: Column | str, element: str = SEGMENT) -> Column:
    return F.coalesce(F.from_json(c, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def segments_to_json(c: Column | str) -> Column:
    """Null stays null: no transcript is not an empty one."""
    return F.to_json(c)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and columns idx, name, category (4 character, 3 series, 1 rating, 0 general)."""
    return spark.read.schema("idx int, name string, category int").csv(path, header=True)


def load_labelled(manifest: DataFrame) -> DataFrame:
    """(category, path) of images that lie directly in a category's directory; `manifest` has path and root."""
    inside = F.expr("substring(path, length(root) + 2)")
    rows = manifest.withColumn("inside", inside).filter(F.col("inside").rlike(r"^[^/]+/[^/]+$") & extension("path").isin(*LABELLED_EXTENSIONS))
    return rows.select(F.substring_index("inside", "/", 1).alias("category"), "path")


def update_centroids(old: DataFrame, new: DataFrame) -> DataFrame:
    """New categories replace those of the same name."""
    return old.join(new.select("category").hint("merge"), "category", "left_anti").unionByName(new)


def lookup(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """path and type of each id asked for; found is false for unknown ones."""
    known = catalog.select("id", "file_path", "media_type").withColumn("found", F.lit(True))
    return ids.join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
