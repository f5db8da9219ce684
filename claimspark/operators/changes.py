"""Changes of tables as functions from tables to tables: updates, deletes with their consequences, inserts of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def update_where(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which `where` is true get the values; null counts as false."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def update_keys(rows: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Rows whose key is in `keys` get the values. The planner picks the join by the keys' size."""
    marked = rows.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return update_where(marked, F.col("_hit"), values).drop("_hit").select(rows.columns)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def delete_where(rows: DataFrame, where: Column) -> DataFrame:
    """Rows for which `where` is not true stay, also where it is null."""
    return rows.filter(~F.coalesce(where, F.lit(False)))


def cascade(children: DataFrame, reference: str, gone: DataFrame, key: str = "id") -> DataFrame:
    """children without those of parents that are gone; a null reference stays."""
    return children.join(gone.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def set_null(children: DataFrame, reference: str, gone: DataFrame, key: str = "id") -> DataFrame:
    """children whose references to parents that are gone are null."""
    marked = children.join(gone.select(F.col(key).alias(reference)).distinct().withColumn("_gone", F.lit(True)), reference, "left")
    return marked.withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(children.columns)


def insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and those of new with no equal key; of equal new keys one row."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(existing.columns))


def union_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left, and rows of right whose key left lacks."""
    return left.unionByName(right.join(left.select(key).distinct(), key, "left_anti").select(left.columns))


def latest_state(feed: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last change of each key; keys that were deleted last are gone. One aggregate with a map-side part."""
    rest = [c for c in feed.columns if c not in (key, seq)]
    last = feed.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("s"))
    return last.select(key, "s.*").filter("op <> 'DELETE'")


def with_parent(rows: DataFrame, parents: DataFrame, reference: str, columns: dict[str, str], key: str = "id") -> DataFrame:
    """rows with some columns of the row that they refer to, null without one."""
    own = parents.select(F.col(key).alias(reference), *[F.col(c).alias(name) for c, name in columns.items()])
    return rows.join(own, reference, "left").select(*rows.columns, *columns.values())


def inserted(existing: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(existing and new rows, the new rows): what new lacks or has null comes of `defaults`, else it is null. A clock is a default like any other."""
    value = lambda c: F.coalesce(*[F.col(c)] * (c in new.columns), defaults.get(c, F.lit(None))).cast(existing.schema[c].dataType).alias(c)
    made = new.select(*[value(c) for c in existing.columns])
    return existing.unionByName(made), made


def one_row(rows: DataFrame) -> Row:
    """The only row; an error if there is none or more."""
    if len(found := rows.limit(2).collect()) != 1:
        raise ValueError(f"one row is wanted; there are {'none' if not found else 'more'}")
    return found[0]


def lookup_row(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row with that key, if there is one."""
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def toggled(chosen: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """chosen ids without those of `ids` that they hold, and with the others."""
    return chosen.join(ids, key, "left_anti").unionByName(ids.join(chosen, key, "left_anti").select(chosen.columns))
