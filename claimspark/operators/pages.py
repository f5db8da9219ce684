"""Deep pages of an ordered table: counts of key ranges say which one holds the offset, and only that one is sorted."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class Ranges(NamedTuple):
    """Bounds of key ranges, the first row's key of each but the first, with the rows before and in each. `order`: columns, nulls last, the last one unique."""

    order: list[str]
    bounds: list[Row]
    before: list[int]
    total: int


def _compared(order: list[str], row: Row, behind: bool, itself: bool) -> Column:
    """Rows on one side of a key; null counts as false. Plain comparisons, so that the scan gets them and skips what its statistics rule out."""
    out = F.lit(itself)
    for c in reversed(order):
        v = row[c]
        beyond, equal = (F.lit(False) if behind else F.col(c).isNotNull(), F.col(c).isNull()) if v is None else ((F.col(c) > F.lit(v)) | F.col(c).isNull() if behind else F.col(c) < F.lit(v), F.col(c) == F.lit(v))
        out = beyond | (equal & out)
    return out


def from_on(order: list[str], row: Row, itself: bool = True) -> Column:
    """Rows at or behind a key (`itself`), or behind it."""
    return _compared(order, row, True, itself)


def up_to(order: list[str], row: Row) -> Column:
    """Rows before a key."""
    return _compared(order, row, False, False)


def ranges(rows: DataFrame, order: list[str], n: int = 64, seed: int = 7) -> Ranges:
    """Counts of about n ranges: bounds from a sample of about 40 keys a range, then one pass that counts. Kept for as long as the table stays as it is."""
    keys = rows.select(*order)
    total = keys.count()
    by = [F.asc_nulls_last(c) for c in order]
    sample = keys.sample(min(1.0, 40 * n / max(1, total)), seed).orderBy(*by).collect() if total else []  # about 40 n keys
    bounds = list(dict.fromkeys(sample[i] for i in range(0, len(sample), max(1, len(sample) // n))))[1:]
    number = reduce(lambda a, b: a + b, [F.coalesce(from_on(order, b), F.lit(False)).cast("int") for b in bounds], F.lit(0)) if bounds else F.lit(0)
    counts = {r["k"]: r["n"] for r in keys.groupBy(number.alias("k")).agg(F.count("*").alias("n")).collect()}  # a row a range
    before, so_far = [], 0
    for k in range(len(bounds) + 1):
        before.append(so_far)
        so_far += counts.get(k, 0)
    return Ranges(order, bounds, before, total)


def page(rows: DataFrame, known: Ranges, number: int, size: int = 100) -> DataFrame:
    """Rows number * size to (number + 1) * size of the order, from the ranges that hold them: filters on their bounds reach the scan, and no other range is sorted."""
    first, last = number * size, (number + 1) * size
    held = [k for k, b in enumerate(known.before) if b < last and (k + 1 == len(known.before) or known.before[k + 1] > first)]
    if first >= known.total or not held:
        return rows.limit(0)
    part = rows
    if held[0] > 0:
        part = part.filter(from_on(known.order, known.bounds[held[0] - 1]))
    if held[-1] < len(known.bounds):
        part = part.filter(up_to(known.order, known.bounds[held[-1]]))
    return part.orderBy(*[F.asc_nulls_last(c) for c in known.order]).offset(first - known.before[held[0]]).limit(size)


def page_with_count(rows: DataFrame, known: Ranges, number: int, size: int = 100) -> DataFrame:
    """A page with the number of all rows, which the ranges know, and whether there may be another."""
    return page(rows, known, number, size).withColumn("n_all", F.lit(known.total).cast("bigint")).withColumn("has_more", F.lit(known.total >= (number + 1) * size))


def next_page(rows: DataFrame, order: list[str], after: Row | None, size: int = 100) -> DataFrame:
    """The page behind the last row seen (the first page without one): a top-k of what is behind, without an offset."""
    part = rows if after is None else rows.filter(from_on(order, after, itself=False))
    return part.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(size)
