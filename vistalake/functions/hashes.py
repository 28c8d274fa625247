"""Perceptual hashes as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance that stands for "one of the hashes is missing", and a grid's columns.
MISSING, WIDTH = 999, 9


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dhash(grid: Column) -> Column:
    """D3: 16 hex digits of an 8 x 9 grey grid, row-major: a bit for each pixel that is darker than the one to its right. '' if the grid isn't whole."""

    def digits(g: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.aggregate(
            F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, c: acc * 2 + (F.get(g, r * WIDTH + c + 1) > F.get(g, r * WIDTH + c)).cast("int")))
        return F.when(F.size(g) == 8 * WIDTH, F.array_join(F.transform(rows, lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), "")).otherwise("")

    return once(grid, digits)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hashes; 999 if one is missing."""
    half = lambda h, k: F.conv(F.substring(h, k, 8), 16, 10).cast("bigint")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    known = (F.length(a) == 16) & (F.length(b) == 16)
    return F.when(known, bits).otherwise(F.lit(MISSING)).cast("int")
