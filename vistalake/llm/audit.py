"""Operator 12: filter interaction audit. Every order in which filters can be applied is enumerated by a recursive CTE over the cells of failure masks.

A document's mask has a bit for each filter that it fails. Documents are counted by part and mask once, in
one pass; what each order does to them depends on the cells only. Recursion starts from the masks that
occur, extends each prefix by every unused filter and carries the bits applied so far; each level says
which cells its step removes, finds removed already, and keeps. The recursion has at most 326 * 32 rows
for five filters, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.shared import discard, documents, written

SPACES = r"[\x20\x09-\x0D]+"
#: Failure conditions on a text alone, and the letter for texts that an earlier document has as well.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
COPIES = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters by letter; a column is true where the text fails."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.size(F.split(text, "[A-Z]", -1)) - 1
    return {
        "A": F.size(words) < WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        "C": 100 * capitals > CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def _bit(letters: str, letter: str) -> int:
    return 1 << letters.index(letter)


def failure_cells(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and failure mask, and those of them labelled quality = 1 and toxic = 1.

    `failures` are conditions on the column `text`, which is never null; by default text_failures. The letter after
    them stands for texts equal, by SHA-256, to that of any smaller doc_id: rows that share the least doc_id are no
    copies, nor are rows without doc_id. Null sources are the part ''; a doc_id labelled twice is good or
    toxic if any of its labels says so. Other columns of both tables are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    failures = failures or text_failures(F.col("text"))
    letters = "".join(failures) + COPIES
    mask = sum((F.when(c, _bit(letters, letter)).otherwise(0) for letter, c in failures.items()), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("key"))
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = written(rows.join(said.hint("merge"), "doc_id", "left"), "failure-marks")
    # Joined by doc_id as well, so that a text that many documents share is no single key.
    first = marks.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    placed = marks.join(first.hint("merge"), ["doc_id", "key"], "left").withColumn("mask", F.col("mask") + F.when(copy, _bit(letters, COPIES)).otherwise(0))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    cells = written(placed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic")), "failure-cells")
    discard(marks)
    return cells


def steps(cells: DataFrame, letters: str) -> DataFrame:
    """(prefix, step, letter, mask, kept, removed, redundant): for each way to begin an order, and each mask in `cells`, what its last step does to documents of that mask (0 or 1)."""
    filters = ", ".join(f"struct('{x}' as letter, {_bit(letters, x)} as bit)" for x in letters)
    return cells.sparkSession.sql(
        f"""with recursive walk(prefix, step, letter, mask, applied, kept, removed, redundant) as (
             select '', 0, '', mask, 0, 1, 0, 0 from (select distinct mask from {{cells}})
             union all
             select concat(w.prefix, f.letter), w.step + 1, f.letter, w.mask, w.applied | f.bit,
                    case when w.mask & (w.applied | f.bit) = 0 then 1 else 0 end,
                    case when w.mask & f.bit <> 0 and w.mask & w.applied = 0 then 1 else 0 end,
                    case when w.mask & f.bit <> 0 and w.mask & w.applied <> 0 then 1 else 0 end
             from walk w lateral view inline(filter(array({filters}), x -> w.applied & x.bit = 0)) f as letter, bit)
           select * from walk where step > 0""", cells=cells)


def audit_filters(cells: DataFrame, letters: str) -> DataFrame:
    """Counts of every step of every order of the filters, by part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `cells` has part, mask, n, good and toxic; bit k of mask is the filter letters[k]. shapley is what the step's
    filter removes, summed over all orders. A part without rows doesn't appear, so an empty table gives none.
    """
    if not 1 <= len(letters) <= 6 or len(set(letters)) < len(letters) or not letters.isalpha():
        raise ValueError("one to six different letters")  # 1 957 prefixes of six
    walk = written(steps(cells, letters), "filter-steps")
    only = F.when(F.col("mask") == F.element_at(F.create_map(*[F.lit(y) for x in letters for y in (x, _bit(letters, x))]), F.col("letter")), 1).otherwise(0)
    each = cells.join(F.broadcast(walk.withColumn("only", only)), "mask")  # at most 326 * 32 rows of five filters
    count = lambda flag, what: F.sum(F.col(flag) * F.col(what)).cast("long")
    done = each.groupBy("part", "prefix", "step", "letter").agg(
        count("kept", "n").alias("kept"), count("removed", "n").alias("removed"), count("redundant", "n").alias("redundant"), count("only", "n").alias("unique_fails"),
        count("removed", "good").alias("good_lost"), count("removed", "toxic").alias("toxic_lost"))
    done = written(done, "filter-prefixes")
    # A prefix of k filters begins (n - k)! orders.
    begins = F.element_at(F.array(*[F.lit(factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    shares = done.groupBy("part", "letter").agg(F.sum(F.col("removed") * begins).cast("long").alias("shapley"))
    orders = walk.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    placed = done.join(F.broadcast(places.drop("step")), "prefix")  # 600 rows of five filters
    return placed.join(shares.hint("merge"), ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = failure_cells(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit_filters(cells, "ABCDE")
