"""Operator 4: quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the table of vote
patterns (at most 3^rules rows, whatever the corpus) estimates how often each rule votes each way on
good and on bad texts, and a text is kept if its posterior probability of being good is at least a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.shared import documents, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ROUNDS = 8
#: name: (measure, votes good up to, votes bad from); a measure in between abstains. Per word or per line of the text.
RULES = {
    "symbols": ("n_symbols / n_words", 0.1, 0.25),
    "symbol_runs": ("n_symbol_runs / n_words", 0.1, 0.2),
    "repeats": ("n_repeat_words / n_words", 0.1, 0.2),
    "lines": ("n_dup_lines / n_lines", 0.25, 0.5),
    "shouting": ("n_upper / word_chars", 0.2, 0.5),
    "exclaims": ("n_exclaims / n_words", 0.1, 0.4),
    "long_words": ("word_chars / n_words", 14.0, 30.0),
    "short_words": ("n_words / word_chars", 0.5, 0.8),
}


def text_measures(docs: DataFrame) -> DataFrame:
    """`docs` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' other counts (all long).

    A null text has no words and no lines: every count is 0. Columns of these names in `docs` are replaced,
    and `_words`, `_lines`, `_one`, `_two`, `_four`, `_windows`, `_placed` and `_twice` are dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: (F.size(F.split(text, pattern, -1)) - 1).cast("long")
    out = docs.withColumn("_words", F.array_remove(F.split(text, SPACES), ""))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Hashes of windows of 1, 2, 4 and 5 words, each from two shorter ones.
    both = lambda a, b, skip: F.zip_with(a, F.slice(b, skip + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))
    out = out.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_two", both("_one", "_one", 1)).withColumn("_four", both("_two", "_two", 2))
    windows = F.slice(both("_four", "_one", 4), 1, F.greatest(F.size("_words") - 4, F.lit(0)))
    out = out.withColumn("_windows", F.when(F.size("_words") >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    # Only a text with a window seen twice needs the sort by window, position.
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    same = lambda x, j: F.get("_placed", j)["h"] == x["h"]
    twice = F.filter("_placed", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    out = out.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("_twice", start, lambda acc, i: F.struct((i + 5).alias("end"), (acc["n"] + i + 5 - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"])
    return out.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count(f"[{SYMBOLS}]"), "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_symbol_runs": count(f"[{SYMBOLS}]+"),
        "n_upper": count("[A-Z]"), "n_exclaims": count("!"),
    }).drop("_words", "_lines", "_one", "_two", "_four", "_windows", "_placed", "_twice")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    out = {}
    for name, (measure, good, bad) in RULES.items():
        over, under = (F.col(c) for c in measure.split(" / "))
        out[name] = F.when(under == 0, 0).when(over <= good * under, 1).when(over >= bad * under, -1).otherwise(0).cast("int")
    return out


def log_odds(weights: list[float]) -> Column:
    """Log odds that a row of votes is good: weights[0] for the prior, then three for each rule, for its votes -1, 0 and 1."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    total = F.get(table, F.lit(0))
    for k, name in enumerate(RULES):
        total = total + F.get(table, F.col(name) + (3 * k + 2))
    return total


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """Weights for log_odds by expectation-maximisation over the counts of vote patterns.

    The first guess is that a text is good unless a rule votes bad. Vote rates are smoothed by one
    vote; a rule is taken to do no worse than chance (a bad vote never speaks for a text, a good one
    never against it), and abstaining says nothing. All rounds are one fold over an array of at most 3^rules patterns.
    """
    n_rules = len(RULES)
    pattern = F.struct(F.array(*[F.col(c) for c in RULES]).alias("v"), F.col("n").alias("n"))
    table = voted.groupBy(*RULES).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sort_array(F.collect_list(pattern)).alias("p"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def rates(share: Column) -> Column:
        """Weights from each pattern's share of good texts."""
        mass = lambda side, k, v: add(F.zip_with("p", share, lambda x, g: F.when((k < 0) | (F.get(x["v"], F.greatest(k, F.lit(0))) == v), x["n"] * (g if side else 1 - g)).otherwise(0.0)))
        smooth = lambda side, k, v: F.log(mass(side, k, v) + 1) - F.log(mass(side, F.lit(-1), F.lit(0)) + 3)
        prior = F.log(mass(1, F.lit(-1), F.lit(0)) + 1) - F.log(mass(0, F.lit(-1), F.lit(0)) + 1)
        ratio = lambda i: smooth(1, F.floor(i / 3).cast("int"), i % 3 - 1) - smooth(0, F.floor(i / 3).cast("int"), i % 3 - 1)
        each = F.transform(F.sequence(F.lit(0), F.lit(3 * n_rules - 1)), lambda i: F.when(i % 3 == 0, F.least(ratio(i), F.lit(0.0))).when(i % 3 == 2, F.greatest(ratio(i), F.lit(0.0))).otherwise(0.0))
        return F.concat(F.array(prior), each)

    def shares(weights: Column) -> Column:
        odds = lambda x: F.get(weights, F.lit(0)) + add(F.transform(x["v"], lambda v, k: F.get(weights, 3 * k + v + 2)))
        return F.transform("p", lambda x: 1 / (1 + F.exp(-odds(x))))

    first = F.transform("p", lambda x: F.when(F.array_contains(x["v"], -1), 0.01).otherwise(0.99))
    table = table.withColumn("w", rates(first))
    for r in range(rounds):
        table = table.withColumn(f"share{r}", shares(F.col("w"))).withColumn("w", rates(F.col(f"share{r}")))
    return table.first()["w"]


def keep_good(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that base_failed or the posterior rejects.

    With few or no rows the smoothed rates are near even and the prior decides. Repeated rows count
    each time; null texts have no words, which fails. All columns stay, whatever their names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    voted = text_measures(packed).withColumn("base_failed", base_failed()).withColumns(votes())
    judged = written(voted.select("row", "base_failed", *RULES), "quality-votes")
    return judged.filter(~F.col("base_failed") & (log_odds(estimate(judged)) >= 0)).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    measures = text_measures(docs).drop("text")
    judged = written(measures.withColumn("base_failed", base_failed()).withColumns(votes()), "quality-votes")
    weights = estimate(judged)
    kept = ~F.col("base_failed") & (log_odds(weights) >= 0)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
