"""Progress of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def progress(log: DataFrame) -> DataFrame:
    """For each file of log(scan_id, event_id, ts, newly): current, total, newly_processed, elapsed seconds, eta, percent.

    Files are counted within hours, and hours are counted on; a long scan is not one task's.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.withColumn("_us", micros).withColumn("_hour", F.floor(F.col("_us") / 3_600_000_000))
    hours = rows.groupBy("scan_id", "_hour").agg(F.count(F.lit(1)).alias("_n"), F.sum("newly").alias("_new"), F.min("_us").alias("_first"))
    scan = Window.partitionBy("scan_id")
    before = scan.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(
        "scan_id", "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_done"), F.coalesce(F.sum("_new").over(before), F.lit(0)).alias("_new_done"),
        F.sum("_n").over(scan).alias("total"), F.min("_first").over(scan).alias("_began"))
    so_far = Window.partitionBy("scan_id", "_hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_count", F.count(F.lit(1)).over(so_far)).withColumn("_newly", F.sum("newly").over(so_far)).join(hours.hint("merge"), ["scan_id", "_hour"])
    rows = rows.withColumns({
        "current": F.col("_done") + F.col("_count"), "newly_processed": (F.col("_new_done") + F.col("_newly")).cast("bigint"), "elapsed": (F.col("_us") - F.col("_began")) / 1e6})
    left = (F.col("total") - F.col("current")) * F.col("elapsed") / F.col("current")
    percent = F.when(F.col("total") > 0, F.col("current") / F.col("total") * 100).otherwise(0.0)
    return rows.withColumn("eta", left).withColumn("percent", percent).select(*log.columns, "current", "total", "newly_processed", "elapsed", "eta", "percent")


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("scan_id").agg(F.sum("newly").cast("bigint").alias("processed"), F.count(F.lit(1)).alias("scanned"))
