"""What a table demands of new rows: values, enum members, references, unique keys. Rows that break it are told apart with their reasons."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraints:
    """not_null: columns; members: column to its allowed values; references: column to (parents, their key); unique: lists of columns.

    Null is no member and refers to nothing, and both are allowed where the column isn't in not_null; keys with a null are never equal.
    """

    not_null: tuple[str, ...] = ()
    members: dict[str, tuple] = field(default_factory=dict)
    references: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()


def _reasons(*said: Column) -> Column:
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def judged(new: DataFrame, rules: Constraints, order: list[str], target: DataFrame | None = None, batch: str | None = None) -> DataFrame:
    """new with `reasons`, which is empty for rows that the table takes.

    Of new rows with an equal unique key the first in `order` (a total order) that breaks nothing else is taken, and none if target has the key. With `batch`, a column
    that numbers batches, all rows of a batch with a broken row are refused. References and keys are met by equality with distinct keys; the first
    of equal keys is an aggregate with a map-side part, so a key that a third of all rows share is no task of its own.
    """
    names, said = new.columns, []
    rows = new
    for column, (parents, key) in rules.references.items():
        mark = f"_of_{column}"
        rows = rows.join(parents.select(F.col(key).alias(column)).dropna().distinct().withColumn(mark, F.lit(True)), column, "left")
        said.append(F.when(F.col(column).isNotNull() & F.col(mark).isNull(), f"reference:{column}"))
    said = [F.when(F.col(c).isNull(), f"null:{c}") for c in rules.not_null] + [F.when(~F.col(c).isin(*values), f"member:{c}") for c, values in rules.members.items()] + said
    rows = rows.select(*names, (_reasons(*said) if said else F.array().cast("array<string>")).alias("reasons"))
    sound = F.size("reasons") == 0
    place, later = F.struct(*order), []
    for i, keys in enumerate(rules.unique):
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        first = rows.filter(sound & whole).groupBy(*keys).agg(F.min(place).alias(f"_first{i}"))
        if target is not None:
            there = target.select(*keys).join(first.select(*keys), list(keys), "left_semi").distinct().withColumn(f"_there{i}", F.lit(True))  # a small load is broadcast, and the table isn't shuffled
            first = first.join(there, list(keys), "left")
        else:
            first = first.withColumn(f"_there{i}", F.lit(None).cast("boolean"))
        later.append((keys, first, whole & (F.col(f"_there{i}").isNotNull() | (place > F.col(f"_first{i}")))))
    checked = rows
    for keys, first, _ in later:
        checked = checked.join(first, list(keys), "left")
    more = [F.when(sound & F.coalesce(taken, F.lit(False)), f"unique:{'+'.join(keys)}") for keys, _, taken in later]
    checked = checked.select(*names, F.concat("reasons", _reasons(*more)).alias("reasons")) if more else checked
    if batch:
        broken = checked.groupBy(batch).agg(F.count_if(F.size("reasons") > 0).alias("_broken"))
        checked = checked.join(broken, batch).select(*names, F.when((F.size("reasons") == 0) & (F.col("_broken") > 0), F.array(F.lit("batch"))).otherwise(F.col("reasons")).alias("reasons"))
    return checked
