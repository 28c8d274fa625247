"""Tables that outlive a job: written as Parquet where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of `written` by application, oldest first.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a scratch folder of our own only where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> None:
    """Write a table as Parquet; an existing one is an error, versions go to new directories."""
    df.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read it again."""
    return spark.read.parquet(path)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), rows_a_file: int = 0) -> DataFrame:
    """`df` written to the shared folder and read back: lineage is cut, and a lost executor costs no recomputation. With `rows_a_file`, files have so many rows at most."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(compression="zstd", maxRecordsPerFile=rows_a_file).partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    found = _written.get(spark.sparkContext.applicationId, [])
    if name in found:
        found.remove(name)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more: what was made of them must be written itself."""
    for df in tables:
        _remove(df.sparkSession, df.written_to)


def clean(spark: SparkSession, *keep: DataFrame) -> int:
    """Delete all tables that `written` has made in this application but those of `keep`; results that still read them can't be used after it. Gives their number."""
    gone = [x for x in _written.get(spark.sparkContext.applicationId, []) if x not in {df.written_to for df in keep}]
    for name in gone:
        _remove(spark, name)
    return len(gone)


def sized(keys: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written or plainly read table of small rows, hinted for a join: it is sent to all tasks if it has `most` rows at most, else both sides are sorted and merged."""
    return keys.hint("broadcast" if keys.count() <= most else "merge")


def write_by_category(df: DataFrame, path: str, column: str = "category", rows: int = 1_000_000) -> None:
    """One directory per category, with a file for about each `rows` rows: a large category is dealt over several tasks."""
    sizes = df.groupBy(F.col(column).alias("_category")).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    keyed = df.withColumn("_key", F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]))
    salted = keyed.join(sizes.hint("merge"), F.col(column).eqNullSafe(F.col("_category"))).withColumn("_part", F.pmod("_key", F.col("_parts")))
    salted.repartition(column, "_part").select(*df.columns).write.partitionBy(column).parquet(path)
