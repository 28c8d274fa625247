"""A stored index of vectors in cells, for exact search that opens few of them.

A cell holds the vectors nearest to its centre; with it are kept its centre, its radius (the largest distance
to the centre) and its number of rows. No row of a cell can score more with a query q than q . centre + |q| *
radius, nor more than |q| times its longest vector: cells are opened in the order of this bound until the k-th best score so far is over the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.functions.vectors import dot
from vistalake.operators.similarity import BLOCK_ROWS, TILE_ROWS, matrix_of, spread_rows
from vistalake.sources.catalog import latest_vectors
from vistalake.sources.tables import discard, fresh_path, sized, written

#: Cells of a generation at most, rows of a sample from which centres are chosen for each cell, and cells that a search opens first.
CELLS, SAMPLE, FIRST = 1024, 8, 4
#: Room for rounding in bounds.
ROOM = 1e-9


def _celled(centres) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, embedding, cell, away, size): the nearest centre, the distance to it, and the vector's length."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            for low in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(low, TILE_ROWS)
                x = matrix_of(part.column("embedding"), unit=False)
                cell = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
                away = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("embedding"), pa.array(cell, pa.int32()), pa.array(away), pa.array(np.sqrt((x * x).sum(axis=1)))], ["id", "embedding", "cell", "away", "size"])

    return assign


class VectorIndex:
    """Vectors (id, embedding) under a path, in generations: one for each call of `add`. The latest vector of an id counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cell_rows: int = BLOCK_ROWS) -> VectorIndex:
        out = cls(vectors.sparkSession, path or fresh_path(vectors.sparkSession, "vector-index"))
        out.add(vectors, cell_rows)
        return out

    def _generations(self) -> list[int]:
        """Numbers of the finished generations: those with a table of cells."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = fs_path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("cells-")) for n in names if n.startswith("cells-") and fs.exists(fs_path(f"{self.path}/{n}/_SUCCESS")))

    def append(self, results: DataFrame, cell_rows: int = BLOCK_ROWS) -> None:
        """S8 on the index: the normalised vectors of successful results(id, success, embedding, seq), the latest of an id, in place of older ones."""
        self.add(latest_vectors(results), cell_rows)

    def add(self, vectors: DataFrame, cell_rows: int = BLOCK_ROWS) -> None:
        """Store vectors in cells of about `cell_rows` rows around centres chosen far apart from a sample. An id has one row in `vectors`; it replaces the id's older ones. Rows without a vector are left out."""
        generation = max(self._generations(), default=-1) + 1
        rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = written(rows, "vectors-to-index")  # it is counted, sampled and dealt to cells
        n = min(CELLS, max(1, -(-rows.count() // cell_rows)))
        sample = rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE * n).toArrow()  # at most SAMPLE * CELLS rows
        centres = spread_rows(matrix_of(sample.column("embedding"), unit=False), n)
        if not len(centres):
            discard(rows)
            return
        sent = self.spark.sparkContext.broadcast(centres)
        celled = rows.mapInArrow(_celled(sent), "id long, embedding array<double>, cell int, away double, size double")
        # Large cells have several files; rows of one are sorted by distance, the ids' statistics stay in the files' footers.
        celled.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors-{generation}")
        discard(rows)
        stored = self.spark.read.parquet(f"{self.path}/vectors-{generation}")
        facts = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.max("size").alias("longest"), F.count(F.lit(1)).alias("n"))
        names = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        facts.join(F.broadcast(names), "cell").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells-{generation}")

    def cells(self) -> list[dict]:
        """Generation, cell, centre, radius, longest and n of all cells: at most CELLS for each generation."""
        return [r.asDict() | {"generation": g} for g in self._generations() for r in self.spark.read.parquet(f"{self.path}/cells-{g}").orderBy("cell").collect()]

    def rows_of(self, cells: list[dict]) -> DataFrame:
        """(id, embedding) of these cells, without ids that a later generation has; other cells' files aren't opened."""
        parts, generations = [], self._generations()
        for g in generations:
            mine = [c["cell"] for c in cells if c["generation"] == g]
            if not mine:
                continue
            part = self.spark.read.schema("id long, embedding array<double>").parquet(*[f"{self.path}/vectors-{g}/cell={c}" for c in mine])
            for later in (x for x in generations if x > g):
                ids = self.spark.read.schema("id long, cell int").parquet(f"{self.path}/vectors-{later}").select("id")
                part = part.join(ids.hint("merge"), "id", "left_anti")
            parts.append(part)
        out = parts[0] if parts else self.spark.createDataFrame([], "id long, embedding array<double>")
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def vectors(self) -> DataFrame:
        """All vectors that count."""
        return self.rows_of(self.cells())

    def top_k(self, query: list[float], k: int = 20, catalog: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """V2: the k rows of highest inner product with the normalised query, ties by id, as top_k_similar of all vectors.

        Cells are opened best bound first, twice as many each time, until the k-th best score is over the bound of
        all that are left. With a catalog, ids without a row in it are dropped afterwards.
        """
        q = np.array(query, float)
        q = q / (np.sqrt((q * q).sum()) or 1.0)
        size = float(np.sqrt((q * q).sum()))
        cells = self.cells()
        for c in cells:
            c["bound"] = min(float(q @ np.array(c["centre"])) + size * c["radius"], size * c["longest"]) + ROOM
        cells.sort(key=lambda c: (-c["bound"], c["generation"], c["cell"]))
        score = dot("embedding", F.array(*[F.lit(float(x)) for x in q])).alias("score")
        best, at, step = self.spark.createDataFrame([], "id long, score double"), 0, max(1, first)
        bar = -np.inf
        while at < len(cells) and cells[at]["bound"] >= bar:
            opened = [c for c in cells[at : at + step] if c["bound"] >= bar]
            found = self.rows_of(opened).select("id", score).unionByName(best)
            best = written(found.orderBy(F.desc("score"), "id").limit(k), "nearest")
            held = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            bar = held["least"] if held["n"] == k else -np.inf
            at, step = at + len(opened), 2 * step
        self.opened = at
        if catalog is None:
            return best.orderBy(F.desc("score"), "id")
        return sized(best).join(catalog.select("id", "file_path"), "id").orderBy(F.desc("score"), "id")
