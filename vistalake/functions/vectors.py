"""Vector expressions on ARRAY<FLOAT> columns; sums run in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistalake.functions.hashes import once


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """V1: unit length; a zero vector stays as it is. The length is computed once, not for each component."""
    v = as_double(v)
    return once(norm(v), lambda length: F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length)))
