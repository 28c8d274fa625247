"""Text hits and snippets over segments(id, kind, pos, start_s, text), kind audio or video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_text(text: Column, query: str) -> Column:
    """Whether the text holds the query, whatever the case; wildcards are ordinary characters."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def segments_table(catalog: DataFrame) -> DataFrame:
    """Transcripts and frame texts of the catalog, a row each, in one pass."""
    audio = F.transform(F.coalesce("audio_transcription", F.array()), lambda s, i: F.struct(F.lit("audio").alias("kind"), i.alias("pos"), s["start"].alias("start_s"), s["end"].alias("end_s"), s["text"].alias("text")))
    video = F.transform(F.coalesce("frame_descriptions", F.array()), lambda s, i: F.struct(F.lit("video").alias("kind"), i.alias("pos"), s["timestamp"].alias("start_s"), F.lit(None).cast("double").alias("end_s"), s["text"].alias("text")))
    return catalog.select("id", F.inline(F.concat(audio, video)))


def text_hits(catalog: DataFrame, segments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first `limit` videos, by id, with a segment that contains the query, whatever the case; wildcards are ordinary characters."""
    ids = segments.filter(contains_text(F.col("text"), query)).select("id").distinct()
    return catalog.filter("media_type = 'video'").join(ids.hint("merge"), "id", "left_semi").orderBy("id").limit(limit)


def snippets(segments: DataFrame, query: str) -> DataFrame:
    """Id, snippet: the first spoken segment with the query, else the first frame text with it."""
    hits = segments.filter(contains_text(F.col("text"), query))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("pos", "start_s", "text")))
    best = hits.groupBy("id").agg(first("audio").alias("a"), first("video").alias("v"))
    said = lambda name, c: F.format_string(f"[{name} @%.1fs] %s", F.col(f"{c}.start_s"), F.col(f"{c}.text"))
    return best.select("id", F.when(F.col("a").isNotNull(), said("Audio", "a")).otherwise(said("Video", "v")).alias("snippet"))
