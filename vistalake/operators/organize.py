"""O1-O3: plans to sort files into category folders, as tables. O4 is vistalake.sources.tables.write_by_category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistalake.operators.listing import match_condition
from vistalake.sources.tables import sized, written


#: Items of one target name that a single task ranks at most.
MOST = 1_000_000


def safe_category(category: Column) -> Column:
    return F.trim(F.regexp_replace(category, r'[<>:"/\\|?*]', "_"))


def ranked(rows: DataFrame, by: tuple[str, ...], order: str, name: str, most: int = MOST) -> DataFrame:
    """`rows` with their rank from 1 by `order` among the rows of equal `by`.

    Where a group has more than `most` rows, rows are dealt by ranges of (by, order), so that it is ranked in several tasks:
    each range ranks its own rows, and what a group has in earlier ranges is added. Of `order` each row of a group has another value.
    """
    if rows.groupBy(*by).count().filter(F.col("count") > most).isEmpty():
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    dealt = written(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # A group of one range has nothing before it; for the few that go over several, their ranges are summed up.
    wide = sizes.groupBy(*by).agg(F.collect_list(F.struct("_part", "_n")).alias("_all")).filter(F.size("_all") > 1)
    before = wide.select(*by, F.explode(F.transform("_all", lambda x: F.struct(x["_part"].alias("_part"), F.aggregate("_all", F.lit(0).cast("long"), lambda acc, y: acc + F.when(y["_part"] < x["_part"], y["_n"]).otherwise(0)).alias("_before")))).alias("_x")).select(*by, "_x.*")
    before = sized(written(before.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), "_before"), "group-starts"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_part") == F.col("_of")]
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order))
    out = dealt.withColumn("_rank", rank).join(before, reduce(lambda a, b: a & b, same), "left")
    return out.withColumn(name, F.col("_rank") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def sort_plan(items: DataFrame, dest_root: str, category: Column, existing: DataFrame, operation: str = "copy", most: int = MOST) -> DataFrame:
    """O1: id, source, dest, operation, success for items(id, file_path, created_at, modified_at, present).

    A name that the folder already holds, on disk (`existing`: path) or from an earlier item of the
    plan, gets the item's time stamp; one that collides even then gets a number as well. Missing sources
    fail and take no name.
    """
    if operation not in ("copy", "move", "dry_run"):
        raise ValueError(f"unknown operation: {operation}")
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    folder = F.concat(F.lit(dest_root.rstrip("/") + "/"), safe_category(category))
    rows = items.withColumn("name", name).withColumn("folder", folder).withColumn("plain", F.concat("folder", F.lit("/"), "name"))
    there = existing.select(F.col("path").alias("plain"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(there.hint("merge"), "plain", "left")
    rows = ranked(rows, ("plain", "present"), "id", "turn", most)
    stamp = F.floor(F.coalesce(F.when(F.col("created_at") != 0, F.col("created_at")), F.col("modified_at"), F.lit(0.0))).cast("bigint")
    stem, ext = F.regexp_replace("name", r"(?<=[^.])\.[^.]*$", ""), F.regexp_extract("name", r"[^.](\.[^.]*)$", 1)
    rename = F.col("taken").isNotNull() | (F.col("turn") > 1)
    rows = rows.withColumn("rename", rename).withColumn("base", F.concat("folder", F.lit("/"), stem, F.lit("_"), stamp.cast("string"))).withColumn("ext", ext)
    held = existing.select(F.col("path").alias("stamped"), F.lit(True).alias("held")).distinct()
    rows = ranked(rows.withColumn("stamped", F.concat("base", "ext")), ("base", "ext", "rename", "present"), "id", "again_at", most).join(held.hint("merge"), "stamped", "left")
    rows = rows.withColumn("again", F.col("again_at") - 1 + F.coalesce(F.col("held"), F.lit(False)).cast("int"))
    number = F.when(F.col("again") > 0, F.concat(F.lit("_"), F.col("again").cast("string"))).otherwise("")
    dest = F.when(F.col("rename"), F.concat("base", number, "ext")).otherwise(F.col("plain"))
    return rows.select("id", F.col("file_path").alias("source"), F.when(F.col("present"), dest).alias("dest"), F.lit(operation).alias("operation"), F.col("present").alias("success"))


def undo_plan(plan: DataFrame) -> DataFrame:
    """O2: what takes a plan back: moves reversed, copies deleted, last first by `seq`; nothing for a dry run."""
    done = plan.filter(F.col("success") & (F.col("operation") != "dry_run"))
    moved = F.col("operation") == "move"
    return done.select((-F.col("id")).alias("seq"), F.when(moved, "move").otherwise("delete").alias("op"), F.col("dest").alias("source"), F.when(moved, F.col("source")).alias("dest"))


def operation_log(plan: DataFrame) -> DataFrame:
    """O2: a line for each file."""
    # The wording of log lines.
    verb = F.when(F.col("operation") == "dry_run", "DRY RUN: DRY_RUN").when(F.col("operation") == "move", "MOVED:").otherwise("COPIED:")
    line = F.when(F.col("success"), F.concat(verb, F.lit(" "), F.col("source"), F.lit(" -> "), F.col("dest"))).otherwise(F.concat(F.lit("ERROR: Source file not found: "), F.col("source")))
    return plan.select(F.col("id").alias("seq"), line.alias("line"))


def organize(catalog: DataFrame, kind: str, value: str, dest_root: str, folder: str, existing: DataFrame, operation: str = "copy") -> tuple[DataFrame, DataFrame]:
    """O3: the plan for all files that meet a condition, and its summary (matched, processed, message)."""
    items = match_condition(catalog, kind, value)
    if "present" not in items.columns:
        items = items.withColumn("present", F.lit(True))
    plan = sort_plan(items, dest_root, F.lit(folder), existing, operation)
    # The wording of messages.
    none = F.lit(f"Operation aborted: No files found for {kind}='{value}'")
    summary = plan.agg(F.count(F.lit(1)).alias("matched"), F.count_if("success").alias("processed"))
    return plan, summary.withColumn("message", F.when(F.col("matched") == 0, none).otherwise(F.concat(F.lit("Processed "), F.col("processed").cast("string"), F.lit(" files"))))
