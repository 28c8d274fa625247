"""Filtered listing, conditions, facets, post-filters, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTED = ("id", "file_path", "media_type", "created_at", "width", "height", "character_tags", "series_tags")


def has_tag(tags: Column | str, value: str) -> Column:
    """a whole tag equals `value`, whatever the case."""
    return F.coalesce(F.exists(tags, lambda x: F.lower(x) == value.lower()), F.lit(False))


def list_media(catalog: DataFrame, limit: int = 50, offset: int = 0, character: str | None = None, series: str | None = None, tag: str | None = None, media_type: str | None = None,
               after: tuple | None = None) -> DataFrame:
    """processed rows that pass the given filters, newest first, ties by id. `after` (created_at, id), the last row seen, gives the rows that follow it without sorting those before."""
    out = catalog.filter("is_processed")
    for column, value in (("character_tags", character), ("series_tags", series)):
        if value and value != "All":
            out = out.filter(has_tag(column, value))
    if tag:
        out = out.filter(has_tag("tags", tag))
    if media_type:
        out = out.filter(F.lower("media_type") == media_type.lower())
    if after is not None:
        out = out.filter(follows(after))
    return out.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).select(*[c for c in LISTED if c in catalog.columns])


def match_condition(catalog: DataFrame, kind: str, value: str) -> DataFrame:
    """processed rows without error that meet a condition: tag, year, media_type, character or series."""
    if not kind or not value:
        raise ValueError("condition needs a type and a value")
    rows = catalog.filter(F.col("is_processed") & F.col("error_msg").isNull())
    holds = lambda column: F.coalesce(F.exists(column, lambda x: F.contains(F.lower(x), F.lit(str(value).lower()))), F.lit(False))
    if kind == "year":
        if not str(value).isdigit():
            raise ValueError(f"year must be a number: {value}")
        edge = lambda year: F.unix_timestamp(F.to_timestamp(F.lit(f"{year:04d}-01-01 00:00:00")))
        return rows.filter((F.col("created_at") >= edge(int(value))) & (F.col("created_at") <= edge(int(value) + 1) - 1))
    if kind == "media_type":
        wanted = str(value).lower()
        for name, words in (("video", ("video", "movie")), ("image", ("image", "photo", "picture"))):
            if any(w in wanted for w in words):
                wanted = name
                break
        return rows.filter(F.col("media_type") == wanted)
    columns = {"tag": "tags", "character": "character_tags", "series": "series_tags"}
    if kind not in columns:
        raise ValueError(f"unknown condition: {kind}")
    return rows.filter(holds(columns[kind]))


def facets(catalog: DataFrame) -> DataFrame:
    """(facet, value, n) of character and series tags over processed rows."""
    rows = catalog.filter("is_processed")
    pairs = F.concat(*[F.transform(F.coalesce(c, F.array()), lambda x: F.struct(F.lit(name).alias("facet"), x.alias("value"))) for name, c in (("character", "character_tags"), ("series", "series_tags"))])
    return rows.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def filter_results(results: DataFrame, media_type: str | None = None, character: str | None = None, series: str | None = None) -> DataFrame:
    """exact, case-sensitive filters on search results; before ranking they fill the page, after it they may not."""
    if media_type and media_type != "All":
        results = results.filter(F.col("media_type") == media_type)
    for column, value in (("character_tags", character), ("series_tags", series)):
        if value and value != "All":
            results = results.filter(F.array_contains(column, value))
    return results


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """one page with has_more on its rows; one row more than the page is read to tell."""
    taken = df.orderBy(*order).offset(offset).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(*order))  # limit + 1 rows
    ranked = taken.withColumn("rank", rank).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return ranked.filter(F.col("rank") <= limit)


def follows(after: tuple, key: str = "created_at", tie: str = "id") -> Column:
    """Rows behind `after` (values of key and tie) where the highest key comes first, null keys last, and ties go by ascending `tie`. The first part of the condition reaches the scan."""
    value, last = after
    if value is None:
        return F.col(key).isNull() & (F.col(tie) > last)
    return ((F.col(key) <= value) & ((F.col(key) < value) | (F.col(tie) > last))) | F.col(key).isNull()


@dataclass
class KeyRange:
    """Rows with a key over `low` and up to `high` (None: open), or with the null key, or with one key and a tie in such a range."""
    where: Column
    n: int
    one_key: bool


class Pages:
    """pages of a table in the order of `key`, highest first, null keys last, ties by ascending `tie`, found by counts.

    Rows are counted once by ranges of the key. Page n sorts the rows of the ranges that it lies in, which hold about
    a RANGES-th of the table each; a key that more rows share is counted by ranges of the tie as well. `tie` must be a number and tell rows apart.
    """

    def __init__(self, df: DataFrame, key: str = "created_at", tie: str = "id", ranges: int = 256, most: int = 100_000):
        self.df, self.key, self.tie, self.parts, self.most = df, key, tie, ranges, most
        self.ranges = self._counted(df, key, descending=True)

    def _counted(self, df: DataFrame, column: str, descending: bool) -> list[KeyRange]:
        """Ranges of a column in the table's order: at most twice `parts`. A value that is more than one of the quantiles is a range of its own."""
        c = F.col(column)
        quantiles = df.agg(F.percentile_approx(column, [k / self.parts for k in range(1, self.parts)], 10 * self.parts).alias("b")).first()["b"] or []
        bounds, heavy = sorted(set(quantiles)), {x for x in quantiles if quantiles.count(x) > 1}
        values = lambda xs: F.array(*[F.lit(x) for x in xs])
        below = F.size(F.filter(values(bounds), lambda x: x < c)) if bounds else F.lit(0)
        number = F.when(c.isNull(), -1).otherwise(2 * below + (F.array_contains(values(heavy), c).cast("int") if heavy else 0))
        rows = df.groupBy(number.alias("range")).agg(F.count(F.lit(1)).alias("n"), (F.min(c) == F.max(c)).alias("one")).collect()
        out = []
        for r in sorted(rows, key=lambda r: -r["range"] if descending else r["range"]):
            k, single = divmod(r["range"], 2)
            if r["range"] < 0:
                where = c.isNull()
            elif single:
                where = c == bounds[k]
            else:
                where = c.isNotNull()
                where = where & (c > bounds[k - 1]) if k > 0 else where
                where = where & ((c < bounds[k]) if bounds[k] in heavy else (c <= bounds[k])) if k < len(bounds) else where
            out.append(KeyRange(where, r["n"], r["range"] < 0 or bool(r["one"])))
        return out

    def _spans(self, offset: int, wanted: int) -> tuple[Column | None, int]:
        """A condition that the rows from `offset` on, `wanted` of them, meet, and how many of those that meet it come before."""
        where, before, at = None, 0, 0
        for r in self.ranges:
            if at + r.n > offset and at < offset + wanted:
                part, skipped = r.where, 0
                if r.one_key and r.n > self.most:  # ties: the same by the tie
                    within = 0
                    part = None
                    for t in self._counted(self.df.filter(r.where), self.tie, descending=False):
                        if at + within + t.n > offset and at + within < offset + wanted:
                            part = t.where if part is None else part | t.where
                        elif part is None:
                            skipped += t.n
                        within += t.n
                    part = r.where & part
                before = at + skipped if where is None else before
                where = part if where is None else where | part
            at += r.n
        return where, offset - before

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """The same rows as page(df, [desc(key), tie], limit, offset), with rank and has_more."""
        order = [F.desc_nulls_last(self.key), F.asc(self.tie)]
        where, skip = self._spans(offset, limit + 1)
        return page(self.df.filter(where if where is not None else F.lit(False)), order, limit, skip)

    def after(self, limit: int, last: tuple | None = None) -> DataFrame:
        """The page behind the row with these values of key and tie; the first one without."""
        rows = self.df if last is None else self.df.filter(follows(last, self.key, self.tie))
        return page(rows, [F.desc_nulls_last(self.key), F.asc(self.tie)], limit)
