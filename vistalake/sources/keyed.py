"""Tables that change by batches (S6, S10, B4), laid out in hash buckets of their key: a batch reads, joins and merges only the buckets that it touches.

`<path>/delta-<n>/bucket=<b>` holds the rows that batch n changed in bucket b, `<path>/whole-<n>/bucket=<b>` all
rows of the bucket as of batch n. What counts in a bucket is its newest whole version and the deltas after
it, and of these the newest rows of each key. Versions become visible by a commit (see Commits), so a batch
that is run again after a failure reads the same versions and writes the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a table, and deltas of a bucket after which its rows are merged.
BUCKETS, COMPACT = 64, 16


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Commits:
    """One row for each finished batch: (batch, buckets, tops), tops being the highest ids by table. The last two are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        found = [int(m[1]) for m in (re.fullmatch(r"batch-(\d+)", x) for x in _names(self.spark, self.path)) if m]
        return sorted(n for n in found if "_SUCCESS" in _names(self.spark, f"{self.path}/batch-{n}"))

    def last(self, below: int | None = None) -> dict | None:
        """The newest commit, or the newest of the batches under `below`."""
        numbers = [n for n in self.numbers() if below is None or n < below]
        return self.spark.read.parquet(f"{self.path}/batch-{numbers[-1]}").first().asDict() if numbers else None

    def put(self, number: int, buckets: int, tops: dict[str, int]) -> None:
        row = self.spark.createDataFrame([(number, buckets, tops)], "batch long, buckets int, tops map<string,long>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        for n in self.numbers():
            if n < number - 1:
                _delete(self.spark, f"{self.path}/batch-{n}")


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, compact: int = COMPACT, gone: str | None = None):
        """gone: a condition on rows that only say that their key has no rows any more."""
        self.spark, self.path, self.key, self.buckets, self.compact, self.gone = spark, path, key, buckets, compact, gone

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(key if key is not None else self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, column: str | None = None) -> list[int]:
        """Buckets of the keys in `keys`; at most `buckets` numbers."""
        return sorted(r["b"] for r in keys.select(self.bucket(column or self.key).alias("b")).distinct().collect())

    def pieces(self, below: int) -> dict[int, list[tuple[int, str]]]:
        """(batch, kind) of the versions under `below` by bucket, oldest first."""
        out: dict[int, list[tuple[int, str]]] = {}
        for m in (re.fullmatch(r"(delta|whole)-(\d+)", x) for x in _names(self.spark, self.path)):
            if m and int(m[2]) < below:
                for b in (re.fullmatch(r"bucket=(\d+)", x) for x in _names(self.spark, f"{self.path}/{m[0]}")):
                    if b:
                        out.setdefault(int(b[1]), []).append((int(m[2]), m[1]))
        return {b: sorted(found) for b, found in out.items()}

    @staticmethod
    def _counting(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
        since = max((n for n, kind in found if kind == "whole"), default=-1)
        return [(n, kind) for n, kind in found if n > since or (n == since and kind == "whole")]

    def _versions(self, below: int, buckets: Iterable[int] | None) -> DataFrame | None:
        found = self.pieces(below)
        paths = [f"{self.path}/{kind}-{n}/bucket={b}" for b in sorted(found if buckets is None else set(buckets) & set(found)) for n, kind in self._counting(found[b])]
        if not paths:
            return None
        return self.spark.read.parquet(*paths).withColumn("_version", F.regexp_extract("_metadata.file_path", r"/(?:delta|whole)-(\d+)/bucket=\d+/[^/]*$", 1).cast("int"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        newest = F.max("_version").over(Window.partitionBy(self.key))
        rows = rows.withColumn("_newest", newest).filter("_version = _newest").drop("_version", "_newest")
        return rows.filter(f"not coalesce({self.gone}, false)") if self.gone else rows

    def read(self, below: int, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The table as of the batches under `below`, or these buckets of it; only their files are opened."""
        rows = self._versions(below, buckets)
        return None if rows is None else self._newest(rows)

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}-{number}")

    def put(self, rows: DataFrame, number: int) -> None:
        """Write the rows that batch `number` puts in place of those of their keys. Buckets with `compact` deltas are merged instead, and lose what is older than their last whole version."""
        found = self.pieces(number)
        touched = self.touched(rows)
        full = [b for b in touched if sum(kind == "delta" for _, kind in self._counting(found.get(b, []))) >= self.compact - 1]
        inside = self.bucket().isin(full)
        self._write(rows.filter(~inside) if full else rows, "delta", number)
        if not full:
            return
        before = self._versions(number, full)
        new = rows.filter(inside).withColumn("_version", F.lit(number))
        self._write(self._newest(new if before is None else before.unionByName(new, allowMissingColumns=True)), "whole", number)
        for b in full:
            whole = max((n for n, kind in found.get(b, []) if kind == "whole"), default=0)
            for n, kind in found.get(b, []):
                if n < whole or (n == whole and kind == "delta"):
                    _delete(self.spark, f"{self.path}/{kind}-{n}/bucket={b}")
        for name in {f"{kind}-{n}" for pieces in found.values() for n, kind in pieces}:
            if not any(x.startswith("bucket=") for x in _names(self.spark, f"{self.path}/{name}")):
                _delete(self.spark, f"{self.path}/{name}")


def highest(tops: dict[str, int] | None, name: str, rows: DataFrame) -> int:
    """The highest id so far, from the last commit and the batch's own rows."""
    return max((tops or {}).get(name, 0), rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"])

