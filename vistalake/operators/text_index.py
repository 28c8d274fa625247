"""An index of segments by character trigrams, so that a substring is looked for in few segments.

Segments are stored with a number each, beside postings: the numbers of the segments that hold a trigram, in rows
sorted by trigram, of which Parquet's statistics let a query open few. A query's trigrams are counted over
their postings; what has all of them is read and checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.operators.text import contains_text
from vistalake.sources.tables import fresh_path, sized, written

#: Characters of a gram; bits of a character; segments whose postings are gathered at a time.
GRAM, BITS, TOGETHER = 3, 21, 2000
POSTINGS = "gram long, numbers array<long>"


def grams_of(text: str | None) -> np.ndarray:
    """Different trigrams of a text, each as one number made of its characters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    return np.unique(points[:-2] << (2 * BITS) | points[1:-1] << BITS | points[2:])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(low, TOGETHER)
            found = [grams_of(t) for t in part.column("lowered").to_pylist()]
            grams = np.concatenate(found)
            numbers = np.repeat(part.column("number").to_numpy(), [len(g) for g in found])
            order = np.lexsort((numbers, grams))
            grams, numbers = grams[order], numbers[order]
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)), pa.int32()), pa.array(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(grams[first]), lists], ["gram", "numbers"])


class SegmentIndex:
    """Segments (id, kind, pos, start_s, text) under a path, in generations: one for each call of `add`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, segments: DataFrame, path: str | None = None) -> SegmentIndex:
        """An index of `segments`, in a new folder of the shared one where no path is given."""
        out = cls(segments.sparkSession, path or fresh_path(segments.sparkSession, "segment-index"))
        out.add(segments)
        return out

    def _generations(self) -> list[int]:
        """Numbers of the finished generations: those with postings."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = fs_path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("postings-")) for n in names if n.startswith("postings-") and fs.exists(fs_path(f"{self.path}/{n}/_SUCCESS")))

    def add(self, segments: DataFrame) -> None:
        """Index more segments. Those of an id that is in the index replace all its older ones."""
        generation = max(self._generations(), default=-1) + 1
        # Ids are dealt by ranges, so that the segments of neighbours lie together; numbers hold once they are written.
        rows = segments.select("id", "kind", "pos", "start_s", "text").repartitionByRange("id", "pos").withColumn("number", F.monotonically_increasing_id())
        stored = f"{self.path}/segments-{generation}"
        rows.write.mode("overwrite").parquet(stored)
        written_rows = self.spark.read.parquet(stored).select("number", F.lower("text").alias("lowered"))
        postings = written_rows.mapInArrow(_postings, POSTINGS)
        # A trigram that a third of all segments hold has many rows, each of TOGETHER numbers at most, in several ranges.
        postings = postings.withColumn("low", F.get("numbers", F.lit(0))).repartitionByRange("gram", "low").sortWithinPartitions("gram", "low").drop("low")
        postings.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/postings-{generation}")

    def segments(self) -> DataFrame | None:
        """All segments that count."""
        return self._newest([self.spark.read.parquet(f"{self.path}/segments-{g}").withColumn("generation", F.lit(g)) for g in self._generations()])

    def _newest(self, parts: list[DataFrame]) -> DataFrame | None:
        """Of hits by generation, those whose id is in no later generation."""
        out, generations = None, self._generations()
        for g, part in zip(generations, parts):
            for later in generations[g + 1 :]:
                ids = self.spark.read.parquet(f"{self.path}/segments-{later}").select("id").distinct()
                part = part.join(ids.hint("merge"), "id", "left_anti")
            out = part if out is None else out.unionByName(part)
        return None if out is None else out.select("id", "kind", "pos", "start_s", "text")

    def candidates(self, query: str, generation: int) -> DataFrame:
        """Numbers of the segments of a generation that hold every trigram of the query."""
        grams = grams_of(query.lower()).tolist()
        found = self.spark.read.parquet(f"{self.path}/postings-{generation}").filter(F.col("gram").isin(grams)).select("gram", F.explode("numbers").alias("number"))
        return found.groupBy("number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("number")

    def matching(self, query: str) -> DataFrame:
        """Segments whose text contains the query, whatever the case. Queries under three characters scan."""
        parts = []
        for g in self._generations():
            rows = self.spark.read.parquet(f"{self.path}/segments-{g}")
            if len(query.lower()) >= GRAM:
                numbers = written(self.candidates(query, g), "segment-candidates")
                rows = rows.join(sized(numbers), "number", "left_semi")
            parts.append(rows.filter(contains_text(F.col("text"), query)))
        found = self._newest(parts)
        if found is None:
            return self.spark.createDataFrame([], "id long, kind string, pos long, start_s double, text string")
        return found
