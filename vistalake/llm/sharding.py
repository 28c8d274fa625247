"""Operator 10: longest-processing-time sharding.

Documents with equal texts form a group that stays together. Groups, largest first, go to the least
loaded shard. Groups of one size are interchangeable, so the schedule needs only the histogram of
group sizes (distinct sizes number at most sqrt(2 * total bytes)): the heap step for all groups of a
size is taken at once, and the groups are then matched to the places by their rank within the size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.shared import discard, documents, fresh_path, written

#: Sub-groups that spread the ranking of one size, and the numbering of one shard, over tasks.
SPREAD = 256
#: Places that the driver holds at a time.
RUNS = 1 << 17


def longest_first(histogram: Iterable[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, first rank, end rank) for a histogram of (size, number of groups)."""
    return list(_dealt(sorted(histogram, reverse=True), n_shards))


def _dealt(histogram: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, int, int, int]]:
    """longest_first of a histogram that comes largest size first; only the loads are kept.

    A shard of load L would take groups of size s at the loads L, L+s, L+2s, ...; the heap takes the
    smallest of all these, so whole rounds follow from a level found by bisection and the heap deals
    out only what is left, fewer than two rounds.
    """
    loads = [0] * n_shards
    for size, count in histogram:
        low = min(loads)
        high = max(loads) + size * (count + 1) if count > 2 * n_shards else low
        while low < high:  # highest level at which no more than `count` groups are dealt
            level = (low + high + 1) // 2
            if sum((level - x + size - 1) // size for x in loads if x < level) <= count:
                low = level
            else:
                high = level - 1
        taken = [max(0, (low - x + size - 1) // size) for x in loads]
        heap = [(x + n * size, k) for k, (x, n) in enumerate(zip(loads, taken))]
        heapq.heapify(heap)
        for _ in range(count - sum(taken)):
            load, k = heap[0]
            taken[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        rank = 0
        for k, n in enumerate(taken):
            if n:
                yield size, k, rank, rank + n
                loads[k] += n * size
                rank += n


def _starts(df: DataFrame, by: str) -> DataFrame:
    """Rows (_n) of each part of each `by`, and those of the parts before (_start); at most SPREAD parts each."""
    before = Window.partitionBy(by).orderBy("_part")
    return df.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.sum("_n").over(before) - F.col("_n"))


def _inside(by: str, order: list[Column]) -> Column:
    """Rank from 0 within a part, so that one large value needs no single task."""
    return F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1


def _schedule(groups: DataFrame, n_shards: int) -> DataFrame:
    """Written (bytes, shard, first, last): which ranks among the groups of a size go to which shard.

    The heap is one sequence, so it runs on the driver; sizes come to it a partition at a time and
    places leave it RUNS at a time, so the driver's memory doesn't grow with the number of sizes.
    """
    spark, path = groups.sparkSession, fresh_path(groups.sparkSession, "shard-runs")
    sizes = groups.groupBy("bytes").count().orderBy(F.desc("bytes")).toLocalIterator()
    places, schema = _dealt(map(tuple, sizes), n_shards), "bytes long, shard int, first long, last long"
    while True:
        batch = list(islice(places, RUNS))
        spark.createDataFrame(batch, schema).write.mode("append").parquet(path)
        if len(batch) < RUNS:
            break
    runs = spark.read.schema(schema).parquet(path)
    runs.written_to = path
    return runs


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`.

    Size is the text's UTF-8 bytes plus 8; a null text counts as the empty one. Rows with equal texts
    share a shard, also where doc_id is null or repeated. An empty table gives no rows; columns other
    than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("text_key"))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    groups = written(groups.withColumn("_part", F.pmod(F.xxhash64("text_key"), F.lit(SPREAD))), "shard-groups")
    runs, starts = _schedule(groups, n_shards), _starts(groups, "bytes")
    meet = (starts["bytes"] == runs["bytes"]) & (F.col("first") < F.col("_start") + F.col("_n")) & (F.col("last") > F.col("_start"))
    pieces = starts.join(runs.hint("merge"), meet).select(
        starts["bytes"], "_part", "shard", (F.col("first") - F.col("_start")).alias("_first"), (F.col("last") - F.col("_start")).alias("_last"))
    ranked = groups.withColumn("_inside", _inside("bytes", [F.col("text_key")]))
    here = (ranked["bytes"] == pieces["bytes"]) & (ranked["_part"] == pieces["_part"]) & (F.col("_inside") >= F.col("_first")) & (F.col("_inside") < F.col("_last"))
    placed = ranked.join(pieces.hint("merge"), here).select("text_key", "shard")
    dealt = rows.join(placed.hint("merge"), "text_key").select("doc_id", "size", "text_crc32", "shard")
    dealt = written(dealt.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SPREAD))), "shard-rows")
    discard(groups, runs)
    slot = _inside("shard", [F.col(c) for c in ("doc_id", "text_crc32", "size")])
    numbered = dealt.withColumn("_inside", slot).join(_starts(dealt, "shard").hint("merge"), ["shard", "_part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_inside")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("int").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
