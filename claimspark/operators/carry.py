"""Ordered passes over groups of any size without a task for a whole group: rows are dealt out by ranges of (group, order), and what comes before a range is carried over.

Pass one writes the rows as a table of ranges, each in order, and numbers the ranges; of each (range, group) it takes a few numbers: how many rows, and the last row for which something holds. A
prefix over these narrow rows, which are as many as ranges and groups together, says what each (range, group) begins with. Pass two reads
the table, counts on inside each range, and joins what was carried. A group that fills a thousand ranges is a thousand tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(rows: DataFrame, keys: list[str], order: list[Column], keep: Callable[[DataFrame], DataFrame], ranges: int | None = None) -> DataFrame:
    """rows with `_range` and `_at`: ranges are in the order of (keys, order), and so are places in a range. Equal rows of that order stay together, so it should be total."""
    by = [*[F.asc_nulls_first(k) for k in keys], *order]
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
    placed = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    return keep(placed)  # the table fixes both


def carried(rows: DataFrame, keys: list[str], order: list[Column], keep: Callable[[DataFrame], DataFrame], place: str | None = None, last: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with `place` (from 1, within their group) and for each of `last` the last value that isn't null of the rows before, null without one.

    keep writes the table of ranges (`shared.kept`). Null keys are a group. A place is that of the row in its range, which needs no window, and what was before; a last value comes of a
    window over (range, group), else of what was carried.
    """
    last = last or {}
    placed = in_ranges(rows, keys, order, keep, ranges)
    # of each (range, group): its rows, its first place, and the last rows that hold a value
    few = placed.groupBy("_range", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *[F.max(F.when(c.isNotNull(), F.struct(F.col("_at").alias("at"), c.alias("v")))).alias(f"_l{i}") for i, c in enumerate(last.values())])
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over narrow rows, one a range and group
    before = few.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_rows"), *[F.max(f"_l{i}").over(w)["v"].alias(f"_b{i}") for i in range(len(last))])
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.last(c, ignorenulls=True).over(inner).alias(f"_o{i}") for i, c in enumerate(last.values())])
    out = [F.col(c) for c in rows.columns] + ([(F.col("_rows") + F.col("_at") - F.col("_first") + 1).cast("bigint").alias(place)] if place else [])
    return own.join(before, on).select(*out, *[F.coalesce(f"_o{i}", f"_b{i}").alias(name) for i, name in enumerate(last)])


#: Rows of a group up to which one task numbers it.
MOST = 1_000_000


#: Hashes by which rows are counted before keys are.
SLOTS = 1 << 14


def crowded(rows: DataFrame, keys: list[str], most: int = MOST, slots: int = SLOTS) -> DataFrame | None:
    """The keys of groups of over `most` rows; none without any.

    Rows are counted by a hash of their keys first, which shuffles no more than `slots` rows a task; keys are counted one by one only where a hash has that many rows.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots))
    full = [r["_slot"] for r in rows.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("_slot").collect()]
    return rows.filter(slot.isin(full)).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys) if full else None


def placed(rows: DataFrame, keys: list[str], order: list[Column], keep: Callable[[DataFrame], DataFrame], place: str, totals: dict[str, Column], most: int = MOST, complete: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """complete(rows) with `place` (from 1, within their group) and, of `totals`, aggregates of the whole group; rows are read more than once, so they should be a table.

    Rows are shuffled once, by their keys, and as narrow as they are given: `complete` adds what follows from a row's own columns, behind the shuffle. Places and totals of a group of
    up to `most` rows come of one window; larger groups, of which there are few, are dealt out by ranges (`carried`). Null keys are a group.
    """
    group = Window.partitionBy(*keys).orderBy(*order)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def by_window(own: DataFrame) -> DataFrame:
        dealt = complete(own.repartition(*keys))
        return dealt.select("*", F.row_number().over(group).cast("bigint").alias(place), *[c.over(whole).alias(name) for name, c in totals.items()])

    hot = crowded(rows, keys, most)
    if hot is None:
        return by_window(rows)
    hot = keep(hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    large = complete(rows.join(F.broadcast(hot), on, "left_semi"))
    sums = large.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(*[c.alias(name) for name, c in totals.items()])
    by_ranges = carried(large, keys, order, keep, place=place).join(F.broadcast(sums), on)
    return by_window(rows.join(F.broadcast(hot), on, "left_anti")).unionByName(by_ranges.drop(*[f"_h{i}" for i in range(len(keys))]))
