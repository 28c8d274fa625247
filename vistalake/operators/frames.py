"""M1-M8: key frames, video pooling, merging of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistalake.operators.tagging import mean_vectors


def keyframe_indices(frame_count: Column, fps: Column) -> Column:
    """M1: ten seconds in and before the end, and the quarters; distinct and sorted first, then cut to the video's frames."""
    ten = F.floor(fps * 10).cast("bigint")
    n = frame_count.cast("bigint")
    quarter = lambda k: F.floor(n * k / 4).cast("bigint")
    found = F.array(F.when(n > ten, ten).otherwise(0), quarter(1), quarter(2), quarter(3), F.when(n > ten, n - ten).otherwise(n - 1))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda i: F.greatest(F.lit(0), F.least(i, n - 1)))


def seconds(frames: Column, fps: Column) -> Column:
    """M2: time stamp of a frame, or duration of so many; 0 without a frame rate."""
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def pool_frames(videos: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """M3: normalised mean of a video's frame vectors; zeros without frames."""
    mean = mean_vectors(frames, "video_id")
    zero = F.array_repeat(F.lit(0.0), size)
    return videos.select("video_id").join(mean.hint("merge"), "video_id", "left").select("video_id", F.coalesce("embedding", zero).alias("embedding"))


def majority(videos: DataFrame, frames: DataFrame, column: str = "style", default: str = "illustration") -> DataFrame:
    """M4: a video's most common value, the first seen on a tie, the default without frames."""
    counts = frames.groupBy("video_id", column).agg(F.count(F.lit(1)).alias("n"), F.min("frame_no").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n"), "seen"))
    best = counts.withColumn("rank", rank).filter("rank = 1").select("video_id", column)
    return videos.select("video_id").join(best, "video_id", "left").select("video_id", F.coalesce(column, F.lit(default)).alias(column))


def concat_frame_tags(frames: DataFrame, column: str, distinct: bool = False) -> DataFrame:
    """M5: all frames' tags in frame order, repeats kept unless `distinct`."""
    empty = F.array().cast("array<string>")
    rows = F.array_sort(F.collect_list(F.struct("frame_no", F.coalesce(column, empty).alias("tags"))))
    tags = F.flatten(F.transform(rows, lambda x: x["tags"]))
    return frames.groupBy("video_id").agg((F.array_distinct(tags) if distinct else tags).alias(column))


def merge_tags(old: Column, new: Column, style: Column) -> Column:
    """M6: old tags, then new ones that are not among the old (repeats within the new stay), then the style if it is in neither."""
    empty = F.array().cast("array<string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    merged = F.concat(old, F.filter(new, lambda x: ~F.array_contains(old, x)))
    return F.when(style.isNull() | F.array_contains(merged, style), merged).otherwise(F.concat(merged, F.array(style)))


def overwrite(old: Column, new: Column) -> Column:
    """M6: character and series tags are replaced where there are new ones, even empty ones."""
    return F.coalesce(new, old)


def face_structs(raw: Column) -> Column:
    """M7: typed face records with their key points; no time stamp means 0.0."""
    return F.transform(raw, lambda f: F.struct(
        f["embedding"].cast("array<float>").alias("embedding"), f["bbox"].cast("array<int>").alias("bbox"), f["det_score"].cast("double").alias("det_score"),
        F.coalesce(f["timestamp"].cast("double"), F.lit(0.0)).alias("timestamp"), f["kps"].cast("array<array<float>>").alias("kps")))


def clean_descriptions(segments: Column) -> Column:
    """M8: frame texts that begin with `Error` go."""
    return F.filter(segments, lambda s: ~F.startswith(s["text"], F.lit("Error")))


