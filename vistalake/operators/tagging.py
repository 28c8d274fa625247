"""Tags from model scores, nearest anchors and centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistalake.functions.vectors import dot, l2_normalize
from vistalake.operators.similarity import TILE_ROWS, matrix_of, nearest_anchors
from vistalake.sources.tables import sized

CHARACTER, SERIES = 4, 3
#: Partial sums of a group between tasks and its total, and groups that a task holds.
PARTIAL_SUMS, GROUPS = 32, 2000


def decode_tags(preds: DataFrame, vocab: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Id, character_tags, series_tags of preds(id, preds): names over the threshold, in the vocabulary's order, `_` as space. Items without any keep empty lists."""
    hits = preds.select("id", F.posexplode("preds").alias("idx", "p")).filter(F.col("p") > threshold)
    named = hits.join(sized(vocab.filter(F.col("category").isin(CHARACTER, SERIES))), "idx").select("id", "idx", "category", F.replace("name", F.lit("_"), F.lit(" ")).alias("name"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("idx", "name")))), lambda x: x["name"])
    found = named.groupBy("id").agg(listed(CHARACTER).alias("character_tags"), listed(SERIES).alias("series_tags"))
    empty = F.array().cast("array<string>")
    return preds.select("id").join(found.hint("merge"), "id", "left").select("id", F.coalesce("character_tags", empty).alias("character_tags"), F.coalesce("series_tags", empty).alias("series_tags"))


def suggest_tags(vectors: DataFrame, anchors: DataFrame, k: int = 5, threshold: float = 0.20) -> DataFrame:
    """The tags of the k nearest anchors(tag_idx, tag, embedding), then only those that reach the threshold, best first; ties by tag_idx. Rows without a vector have none."""
    named = anchors.select(F.struct("tag_idx", "tag").alias("anchor"), "embedding")
    found = nearest_anchors(vectors, named, "anchor", k)
    return found.select("id", F.transform(F.filter("found", lambda x: x["score"] >= threshold), lambda x: x["anchor"]["tag"]).alias("tags"))


def mean_vectors(vectors: DataFrame, by: str, unit_members: bool = False) -> DataFrame:
    """Mean of embeddings by group, normalised. Vectors without a group, and null ones, don't count.

    Each task adds up the vectors of a group; what is shuffled is a row for each group and task, first to several
    partial sums of a group, then to one, so that a group that most rows share is no single task's. The sums that are
    put together last are sorted by group, so that no group is handed out before all of it is seen.
    """
    kind = vectors.schema[by].dataType.simpleString()
    members = vectors.filter(F.col("embedding").isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("group"), "embedding")
    schema = f"group {kind}, n long, total array<double>"
    parts = members.mapInArrow(_added(unit_members), schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTIAL_SUMS)))
    for keys in (("group", "part"), ("group",)):
        parts = parts.repartition(*keys).sortWithinPartitions("group").select("group", "n", "total").mapInArrow(_added(), schema)
        parts = parts.withColumn("part", F.lit(0)) if len(keys) == 2 else parts
    return parts.select(F.col("group").alias(by), l2_normalize(F.transform("total", lambda x: x / F.col("n"))).alias("embedding"))


def _added(unit_members: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(group, n, total): sums of (group, embedding), or of such sums, for each group that a task meets. With more than GROUPS groups in hand, all but the newest, which sorted rows may go on with, go out and counting begins anew."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.float64()))], ["group", "n", "total"])

        for batch in batches:
            kind, summed = batch.column("group").type, "total" in batch.schema.names
            for low in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(low, TILE_ROWS)
                m = matrix_of(part.column("total" if summed else "embedding"), unit=unit_members)
                n = part.column("n").to_numpy() if summed else np.ones(len(m), np.int64)
                code = part.column("group").dictionary_encode()
                order = np.argsort(code.indices.to_numpy(), kind="stable")
                first = np.flatnonzero(np.diff(code.indices.to_numpy()[order], prepend=-1))
                for group, count, total in zip(code.dictionary.to_pylist(), np.add.reduceat(n[order], first), np.add.reduceat(m[order], first, axis=0)):
                    before = held.get(group, (0, 0.0))
                    held[group] = int(before[0] + count), before[1] + total
                if len(held) > GROUPS:
                    newest, value = held.popitem()
                    yield out()
                    held.clear()
                    held[newest] = value
        if held:
            yield out()

    return add


def prompt_centroid(vectors: DataFrame, group: str) -> DataFrame:
    """Mean of the group's unit vectors, normalised."""
    return mean_vectors(vectors, group, unit_members=True)


def train_centroids(vectors: DataFrame, label: str = "category") -> DataFrame:
    """T5: mean of each category's vectors, normalised; categories without a vector are left out."""
    return mean_vectors(vectors, label)


def classify_binary(vectors: DataFrame, anchor_a: list[float], anchor_b: list[float], a: str = "photo", b: str = "illustration") -> DataFrame:
    """T4: `a` if the first anchor scores higher; `b` otherwise, on a tie as well."""
    to = lambda anchor: dot("embedding", F.array(*[F.lit(float(x)) for x in anchor]))
    return vectors.select("id", F.when(to(anchor_a) > to(anchor_b), a).otherwise(b).alias("style"))


def classify(vectors: DataFrame, centroids: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Id, category, similarity of the nearest of centroids(category, ord, embedding); the first wins ties; null under the threshold, without centroids or without a vector."""
    unit = vectors.select("id", l2_normalize("embedding").alias("embedding"))
    named = centroids.select(F.struct("ord", "category").alias("place"), "embedding")
    best = F.get("found", F.lit(0))
    return nearest_anchors(unit, named, "place", 1, threshold).select("id", best["place"]["category"].alias("category"), best["score"].alias("similarity"))


def gate(df: DataFrame, style: str, scorer: Callable[[DataFrame], DataFrame], wanted: str = "illustration") -> DataFrame:
    """Only rows of the wanted style are scored (id, character_tags, series_tags); the others get empty lists."""
    scored = scorer(df.filter(F.col(style) == wanted))
    empty = F.array().cast("array<string>")
    return df.join(scored.hint("merge"), "id", "left").withColumns({c: F.coalesce(c, empty) for c in ("character_tags", "series_tags")})
