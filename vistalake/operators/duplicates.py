"""Near-duplicate pairs and what to keep of them. D3 and D4 are in vistalake.functions.hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistalake.functions.hashes import MISSING, hamming, once
from vistalake.operators.similarity import similar_pairs
from vistalake.sources.tables import written

# Fixed value: what may follow the common beginning of numbered names.
NUMBERED = r"(?i)^[_ \-p\(r]*[0-9]+[\)]*$"
MARGIN = 1.05
SIDES = ("file_path", "media_type", "file_size", "created_at", "width", "height", "duration", "dhash")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def is_sequential(path_a: Column, path_b: Column) -> Column:
    """Names of one numbered series: three or more characters in common at the front, and numbers or nothing after."""
    def judged(names: Column) -> Column:
        a, b = names["a"], names["b"]
        same = lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))
        places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
        shared = F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) != "") & same(i), i).otherwise(n))
        rest = lambda s, n: F.substring(s, n + 1, F.length(s))
        fits = lambda s, n: (rest(s, n) == "") | rest(s, n).rlike(NUMBERED)
        return once(shared, lambda n: (F.length(a) >= 3) & (F.length(b) >= 3) & (n >= 3) & fits(a, n) & fits(b, n))

    return once(F.struct(stem(path_a).alias("a"), stem(path_b).alias("b")), judged)


def pair_compatible(similarity: Column, threshold_video: float = 0.98, seconds: float = 2.0) -> Column:
    """Types agree; videos also in length and with higher similarity."""
    same = F.col("media_type_a") == F.col("media_type_b")
    zero = F.lit(0.0)
    near = F.abs(F.coalesce("duration_a", zero) - F.coalesce("duration_b", zero)) <= seconds
    return same & ((F.col("media_type_a") != "video") | (near & (similarity >= threshold_video)))


def hash_gate(hash_a: Column, hash_b: Column, max_distance: int = 8, pass_missing: bool = False) -> Column:
    """Image pairs must be close by their hashes; pairs with a missing hash pass only if asked."""
    distance = hamming(F.coalesce(hash_a, F.lit("")), F.coalesce(hash_b, F.lit("")))
    return (F.col("media_type_a") != "image") | (distance <= max_distance) | (F.lit(pass_missing) & (distance == MISSING))


def recommend() -> Column:
    """struct(action, reason): the larger picture, else the larger file, else the older one is kept."""
    area = lambda s: F.coalesce(F.col(f"width_{s}"), F.lit(0)).cast("bigint") * F.coalesce(F.col(f"height_{s}"), F.lit(0)).cast("bigint")
    size = lambda s: F.col(f"file_size_{s}")
    dims = lambda s: F.concat(F.coalesce(F.col(f"width_{s}").cast("string"), F.lit("None")), F.lit("x"), F.coalesce(F.col(f"height_{s}").cast("string"), F.lit("None")))
    kb = lambda s: F.concat(F.floor(size(s) / 1024).cast("string"), F.lit("KB"))
    # Actions and the wording of reasons.
    pick = lambda action, reason: F.struct(F.lit(action).alias("action"), reason.alias("reason"))
    by = lambda what, s, o, text: F.concat(F.lit(f"{what} {s.upper()} ("), text(s), F.lit(f") > {o.upper()} ("), text(o), F.lit(")"))
    return (F.when(area("a") > area("b") * MARGIN, pick("keep_a", by("Resolution", "a", "b", dims)))
            .when(area("b") > area("a") * MARGIN, pick("keep_b", by("Resolution", "b", "a", dims)))
            .when(size("a") > size("b") * MARGIN, pick("keep_a", by("File Size", "a", "b", kb)))
            .when(size("b") > size("a") * MARGIN, pick("keep_b", by("File Size", "b", "a", kb)))
            .when(F.col("created_at_a") < F.col("created_at_b"), pick("keep_a", F.lit("A is older (likely original)")))
            .otherwise(pick("keep_b", F.lit("B is older (likely original)"))))


def with_sides(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Both files' columns beside each pair; pairs with an unprocessed or unknown file go."""
    rows = written(catalog.filter("is_processed").select("id", *SIDES), "sides")  # hashes are computed once for each file
    side = lambda s: rows.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in SIDES])
    return pairs.join(side("a").hint("merge"), "id_a").join(side("b").hint("merge"), "id_b")


def similar_with_sides(vectors: DataFrame, catalog: DataFrame, threshold: float = 0.95) -> DataFrame:
    """J4 on V4: similar_pairs with both files' columns. Columns go to the vectors before they are compared, and pairs come with them: no pair is shuffled."""
    rows = catalog.filter("is_processed").select("id", *SIDES)
    return similar_pairs(vectors.select("id", "embedding").join(rows.hint("merge"), "id"), threshold, beside=SIDES)


def find_duplicates(catalog: DataFrame, vectors: DataFrame, threshold_image: float = 0.95, threshold_video: float = 0.98, pass_missing: bool = False) -> DataFrame:
    """id_a, id_b, similarity, action, reason of duplicate files; catalog has a dhash column, computed once per file."""
    pairs = similar_with_sides(vectors, catalog, threshold_image)
    pairs = pairs.filter(pair_compatible(F.col("similarity"), threshold_video))
    pairs = pairs.filter(hash_gate(F.col("dhash_a"), F.col("dhash_b"), pass_missing=pass_missing))
    pairs = pairs.filter(~is_sequential(F.col("file_path_a"), F.col("file_path_b")))
    advice = pairs.withColumn("advice", recommend())
    return advice.select("id_a", "id_b", "similarity", "advice.action", "advice.reason")
