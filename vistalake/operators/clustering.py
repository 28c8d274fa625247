"""Density clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistalake.operators.similarity import BLOCK_ROWS, Blocks, gathered, met_rows
from vistalake.sources.tables import discard, written

#: Close pairs for each row that a block may give of itself; two blocks may give one for each of their rows.
INSIDE = 16


def connected(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(id, label) after edges(a, b), both directions given: the least label that each id reaches."""
    while True:
        near = edges.join(labels.hint("merge"), F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        moved = step.groupBy("old").agg(F.min("label").alias("to"))
        step = written(step.join(moved.hint("merge"), "old").select("id", "old", F.least("label", "to").alias("label")), "cluster-labels")
        labels = step.select("id", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def _near(low: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(p, q, own, a, b, n): the close pairs a (in block own, which is p) and b (in q) of a pair of blocks, if they are no more than its rows (INSIDE times as many in one block); else how many each row a (in block own) is in."""
        for column, tiles, (p, q, first) in met_rows(batches, low, low_open=False):
            ids = column("id").to_numpy()
            most = len(ids) * (INSIDE if p == q else 1)
            pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]
            n, total = np.zeros(len(ids), np.int64), 0
            for i, j, _ in tiles:
                total += len(i)
                pairs.append((i, j))
                if total > most:
                    for k in (x for pair in pairs for x in pair):
                        n += np.bincount(k, minlength=len(n))
                    pairs = []
            if total <= most:
                i, j = (np.concatenate(x) for x in zip(*pairs))
                b, times = pa.array(ids[j]), pa.nulls(total, pa.int64())
            else:
                i = np.flatnonzero(n)
                b, times = pa.nulls(len(i), pa.int64()), pa.array(n[i])
            blocks = [pa.array(x, pa.int32()) for x in (np.full(len(i), p), np.full(len(i), q), np.where(i < first, p, q))]
            yield pa.RecordBatch.from_arrays([*blocks, pa.array(ids[i]), b, times], ["p", "q", "own", "a", "b", "n"])

    return near


def _bonds(low: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, core): the least core point that each core point reaches in a pair of blocks, two million close pairs at a time, and the core points beside a border point, which are few."""
        for column, tiles, _ in met_rows(batches, low, low_open=False):
            ids = column("id").to_numpy()
            core = np.isin(ids, column("cores").to_numpy())
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]]
            for i, j, _ in gathered(tiles, 1 << 21):
                both = core[i] & core[j]
                u, v, least = i[both], j[both], ids.copy()
                while len(u):
                    before = least.copy()
                    np.minimum.at(least, u, before[v])
                    np.minimum.at(least, v, least[u])
                    if (least == before).all():
                        break
                moved = np.flatnonzero(least != ids)
                one = core[i] != core[j]
                u, v = i[one], j[one]
                border, beside = np.where(core[u], v, u), np.where(core[u], u, v)
                for values, value in zip(out, (np.concatenate([ids[moved], ids[border]]), np.concatenate([least[moved], ids[beside]]), np.repeat([True, False], [len(moved), len(border)]))):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["a", "b", "core"])

    return bind


def _sparse_bonds(near: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, core) of the written pairs of `near`: pairs of core points, and the core points beside a border point."""
    flag = lambda c: cores.select(F.col("id").alias(c), F.lit(True).alias(f"core_{c}")).hint("merge")
    both = near.filter("b is not null").select("a", "b").join(flag("a"), "a", "left").join(flag("b"), "b", "left").filter("core_a or core_b")
    turned = F.col("core_a").isNotNull() & F.col("core_b").isNull()  # the border point comes first
    return both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), (F.col("core_a").isNotNull() & F.col("core_b").isNotNull()).alias("core"))


def numbered(names: DataFrame, column: str) -> DataFrame:
    """`names` with a gapless number from 0 in the order of `column`: rows are dealt by ranges, each range is numbered by itself."""
    dealt = written(names.repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return dealt.withColumn("_rank", rank).join(starts.hint("merge"), "_part").withColumn("number", F.col("_start") + F.col("_rank")).drop("_part", "_rank", "_start")


def dbscan(vectors: DataFrame, eps: float = 0.65, min_samples: int = 4, rows: int = BLOCK_ROWS, pivots: int | None = None) -> DataFrame:
    """Id, cluster_id of vectors(id, embedding) by Euclidean distance of unit vectors, a point counting itself.

    Clusters are numbered from 0 by their least core id; a border point takes the lowest number next to
    it; noise is -1. Blocks meet once: a pair of blocks gives its close pairs, or, if they are more than its rows, a count for each
    point. Only such dense pairs of blocks meet again, when the core points are known, and are joined there. So what is
    written of a pair of blocks is never more than its rows (INSIDE times as many of a block with itself). Pairs of blocks that are too far apart are not made.
    """
    low, points = 1 - eps * eps / 2, vectors.select("id", "embedding")
    blocks = Blocks(points, low, rows, pivots)
    packed = blocks.pack()
    near = written(blocks.meet(packed, _near(low), "p int, q int, own int, a long, b long, n long"), "near-points")
    ends = F.array(F.struct("own", F.col("a").alias("id"), F.coalesce("n", F.lit(1)).alias("n")), F.struct(F.col("q").alias("own"), F.col("b").alias("id"), F.lit(1).cast("long").alias("n")))
    degree = written(near.select(F.inline(ends)).filter("id is not null").groupBy("id", "own").agg(F.sum("n").alias("n")), "degrees")
    enough = F.coalesce("n", F.lit(0)) + 1 >= min_samples
    parts, known = [_sparse_bonds(near, degree.filter(enough).select("id"))], packed
    dense = near.filter("b is null").select("p", "q").distinct()
    if not dense.isEmpty():
        only = dense.groupBy(F.col("p").alias("own")).agg(F.collect_list("q").alias("only"))  # a row for each block
        asked = dense.select(F.explode(F.array("p", "q")).alias("own")).distinct()
        cored = degree.filter(enough).groupBy("own").agg(F.collect_list("id").alias("cores"))  # a row for each block
        beside = asked.join(cored.hint("merge"), "own", "left").join(only.hint("merge"), "own", "left").withColumn("cores", F.coalesce("cores", F.array().cast("array<long>")))
        known = written(packed.join(beside.hint("merge"), "own"), "core-blocks", rows_a_file=1)
        discard(packed)
        parts.append(blocks.meet(known, _bonds(low), "a long, b long, core boolean").distinct())
    bonds = written(reduce(DataFrame.unionByName, parts), "cluster-bonds")
    discard(known, near)
    inner = bonds.filter("core")
    edges = inner.select("a", "b").unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = points.select("id").join(degree.hint("merge"), "id", "left").filter(enough)
    labels = connected(core.select("id", F.col("id").alias("label")), edges)
    numbers = numbered(labels.select("label").distinct(), "label").withColumnRenamed("number", "cluster")
    cores = written(labels.join(numbers.hint("merge"), "label").select("id", "cluster"), "core-clusters")
    border = bonds.filter("not core").join(cores.select(F.col("id").alias("b"), "cluster").hint("merge"), "b").groupBy("a").agg(F.min("cluster").alias("beside"))
    out = vectors.select("id").join(cores.hint("merge"), "id", "left").join(border.hint("merge"), F.col("id") == F.col("a"), "left")
    return out.select("id", F.coalesce("cluster", "beside", F.lit(-1)).cast("int").alias("cluster_id"))


def assign_clusters(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Faces with their new cluster_id; faces without a label keep theirs."""
    new = labels.select("id", F.col("cluster_id").alias("_new"))
    return faces.join(new.hint("merge"), "id", "left").withColumn("cluster_id", F.coalesce("_new", "cluster_id")).drop("_new")


def cluster_summary(labels: DataFrame) -> DataFrame:
    """Number of clusters, clustered points and noise; zeros for no rows."""
    inside = F.col("cluster_id") >= 0
    return labels.agg(F.countDistinct(F.when(inside, F.col("cluster_id"))).alias("n_clusters"), F.count_if(inside).alias("n_clustered"), F.count_if(~inside).alias("n_noise"))
