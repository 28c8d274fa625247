"""A dictionary of tags with bitmaps of the ids that have them.

A condition on tags runs over the dictionary, whatever the number of rows; its ids are the union of bitmaps, and
facets count the bits that a tag's bitmap has in common with the current filters. A bitmap covers
32 768 ids, so a tag that every row has is dealt over as many rows as there are such blocks of ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators.listing import match_condition
from vistalake.sources.tables import fresh_path, sized, written

#: Tag columns of a catalog by the name of their condition and facet.
KINDS = {"tag": "tags", "character": "character_tags", "series": "series_tags"}
#: Ids of a bitmap.
BITS = 32768
#: Rows that facets count, and rows that conditions look at.
PROCESSED, LISTED = "processed", "listed"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id) of (bucket, bitmap), as bitmap_bucket_number and bitmap_bit_position place them."""
    for batch in batches:
        for bucket, bitmap in zip(batch.column("bucket").to_pylist(), batch.column("bitmap").to_pylist()):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
            yield pa.RecordBatch.from_arrays([pa.array((bucket - 1) * BITS + at + 1 if bucket > 0 else bucket * BITS - at, pa.int64())], ["id"])


def _bitmaps(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bitmap"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    """(bucket, bitmap) of the ids that are in every one of `parts`."""
    out = parts[0].withColumn("part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("part", F.lit(k)))
    both = out.groupBy("bucket").agg(F.countDistinct("part").alias("n"), F.expr("bitmap_and_agg(bitmap)").alias("bitmap"))
    return both.filter(F.col("n") == len(parts)).select("bucket", "bitmap")


class TagIndex:
    """Tags of a catalog (id, is_processed, error_msg, and the columns of KINDS) under a path; made anew when the catalog changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, catalog: DataFrame, path: str | None = None) -> TagIndex:
        out = cls(catalog.sparkSession, path or fresh_path(catalog.sparkSession, "tag-index"))
        empty = F.array().cast("array<string>")
        named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("tag"))
        listed = F.concat(*[F.transform(F.coalesce(column, empty), named(kind)) for kind, column in KINDS.items()])
        tags = written(catalog.select("id", "is_processed", F.inline(listed)).groupBy("kind", "tag", "id", "is_processed").agg(F.count(F.lit(1)).alias("times")), "tags-of-rows")
        _bitmaps(tags, "kind", "tag").withColumn("lowered", F.lower("tag")).repartitionByRange("kind", "lowered", "bucket").sortWithinPartitions("kind", "lowered").write.parquet(f"{out.path}/tags")
        # Few rows name a tag more than once; what they add to facets is kept beside the bitmaps.
        tags.filter("times > 1").select("kind", "tag", "id", (F.col("times") - 1).alias("more")).write.parquet(f"{out.path}/repeats")
        flags = {PROCESSED: F.col("is_processed"), LISTED: F.col("is_processed") & F.col("error_msg").isNull()}
        flagged = catalog.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]), lambda x: x.isNotNull())).alias("flag"))
        _bitmaps(flagged, "flag").write.parquet(f"{out.path}/flags")
        return out

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def flagged(self, flag: str) -> DataFrame:
        """(bucket, bitmap) of the rows that are processed, or listed (processed and without error)."""
        return self._table("flags").filter(F.col("flag") == flag).select("bucket", "bitmap")

    def having(self, kind: str, value: str, whole: bool = False) -> DataFrame:
        """(bucket, bitmap) of the ids with a tag that contains `value`, or equals it if `whole`, whatever the case."""
        wanted = F.lit(value.lower())
        hit = F.col("lowered") == wanted if whole else F.contains("lowered", wanted)
        return self._table("tags").filter((F.col("kind") == kind) & hit).groupBy("bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))

    def ids(self, bitmaps: DataFrame) -> DataFrame:
        return bitmaps.select("bucket", "bitmap").mapInArrow(_members, "id long")

    def has_tag(self, rows: DataFrame, kind: str, value: str, name: str) -> DataFrame:
        """`rows` with a column `name`: whether the id has the whole tag, whatever the case."""
        found = sized(written(self.ids(self.having(kind, value, whole=True)).withColumn(name, F.lit(True)), "tag-hits"))
        return rows.join(found, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def match_condition(self, catalog: DataFrame, kind: str, value: str) -> DataFrame:
        """as listing.match_condition; conditions on tags are looked up in the dictionary and only the rows found are joined."""
        if kind not in KINDS or not value:
            return match_condition(catalog, kind, value)
        found = written(self.ids(all_of([self.having(kind, str(value)), self.flagged(LISTED)])), "condition-hits")
        return catalog.join(sized(found), "id", "left_semi")

    def facets(self, conditions: Iterable[tuple[str, str]] = (), whole: bool = True) -> DataFrame:
        """(facet, value, n) of character and series tags over processed rows that meet every condition (kind, tag); tags without such a row are left out."""
        kept = written(all_of([self.flagged(PROCESSED), *[self.having(kind, value, whole) for kind, value in conditions]]), "facet-filter")
        tags = self._table("tags").filter(F.col("kind").isin("character", "series"))
        both = tags.join(kept.withColumnRenamed("bitmap", "kept").hint("merge"), "bucket").select("kind", "tag", "bucket", F.explode(F.array("bitmap", "kept")).alias("bitmap"))
        counted = both.groupBy("kind", "tag", "bucket").agg(F.bitmap_count(F.expr("bitmap_and_agg(bitmap)")).alias("n")).select("kind", "tag", "n")
        repeats = self._table("repeats").filter(F.col("kind").isin("character", "series")).join(self.ids(kept).hint("merge"), "id", "left_semi").select("kind", "tag", F.col("more").alias("n"))
        return counted.unionByName(repeats).groupBy(F.col("kind").alias("facet"), F.col("tag").alias("value")).agg(F.sum("n").cast("long").alias("n")).filter("n > 0")
