"""Stored tables that change: loads that keep what they refuse, and updates that rewrite the touched partitions only."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.operators.changes import update_where
from claimspark.operators.constraints import Constraints, judged
from claimspark.operators.references import Reference, going, in_order

from .shared import has_folders, kept, remove

TAKEN, REFUSED = "taken", "refused"


def _dynamic(rows: DataFrame, by: list[str], path: str) -> None:
    """Replaces the partitions that rows have, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load(new: DataFrame, path: str, load_id: str, rules: Constraints, order: list[str], batch: str | None = None) -> None:
    """Rows that the table at `path` takes go to path/verdict=taken/load=..., the others with their reasons to path/verdict=refused/load=..., in one pass and one job.

    The load has partitions of its own, and unique keys are held against other loads' rows: running it again, also after it was
    stopped, gives the same two tables. What an earlier run of it left is removed first.
    """
    spark = new.sparkSession
    earlier = loaded(spark, path)
    own = None if earlier is None else earlier.filter(F.col("load") != F.lit(load_id))
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(load_id)
    for verdict in (TAKEN, REFUSED):
        remove(spark, f"{path}/verdict={verdict}/load={name}")
    rows = judged(new, rules, order, own, batch)
    verdict = F.when(F.size("reasons") == 0, TAKEN).otherwise(REFUSED)
    _dynamic(rows.withColumn("verdict", verdict).withColumn("load", F.lit(load_id)), ["verdict", "load"], path)


def _loads(spark: SparkSession, at: str) -> DataFrame | None:
    """A table with its loads' names as they were given; none without any load."""
    if not has_folders(spark, at):
        return None
    found = spark.read.option("basePath", at).parquet(at).schema
    named = T.StructType([T.StructField(f.name, T.StringType() if f.name == "load" else f.dataType) for f in found])  # 007 is no number
    return spark.read.schema(named).option("basePath", at).parquet(at)


def loaded(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that were taken, with `load`; none if nothing was."""
    rows = _loads(spark, f"{path}/verdict={TAKEN}")
    return None if rows is None else rows.drop("reasons")


def refused(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that were refused, with `reasons` and `load`; none if nothing was."""
    return _loads(spark, f"{path}/verdict={REFUSED}")


def rewrite(spark: SparkSession, path: str, by: list[str], touched: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> int:
    """Rewrites the partitions (of columns `by`) that hold a row of touched(table) as change(all rows of these); how many there were.

    Files of other partitions keep their names and times, and are not read by the second pass. New files are written aside, then folders change places one by
    one: the old folder is set aside before the new one takes its place, so a stop leaves one of the two to find. A partition that loses all its
    rows goes. touched keeps columns of the table, change the partition columns as they are. The list of folders is read by the driver: it grows with the partitions, not the rows.
    """
    table = spark.read.parquet(path)
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    hit = [r[0] for r in touched(table.select("*", folder.alias("_folder"))).select("_folder").distinct().collect()]
    if not hit:
        return 0
    jvm = spark._jvm
    old = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in hit]
    aside = jvm.org.apache.hadoop.fs.Path(path, f"_rewrite-{uuid.uuid4().hex}")
    files = aside.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = spark.read.schema(table.schema).option("basePath", path).parquet(*[f.toString() for f in old])
    change(rows).select(table.columns).write.partitionBy(*by).parquet(f"{aside.toString()}/new")
    for i, was in enumerate(old):
        parts = was.toString().split("/")[-len(by) :]
        now, before = jvm.org.apache.hadoop.fs.Path(f"{aside.toString()}/new/{'/'.join(parts)}"), jvm.org.apache.hadoop.fs.Path(aside, f"old-{i}")
        files.mkdirs(aside)
        files.rename(was, before)
        if files.exists(now):
            files.rename(now, was)
    files.delete(aside, True)
    return len(hit)


def update_stored(spark: SparkSession, path: str, by: list[str], keys: DataFrame, key: str, values: dict[str, Column]) -> int:
    """Rows whose key is in `keys` get the values, which may use other columns of keys; only the partitions that hold such rows are rewritten."""
    if moved := set(values) & set(by):
        raise ValueError(f"an update can't move rows to other partitions: {', '.join(sorted(moved))}")
    own = keys.dropDuplicates([key]).withColumn("_hit", F.lit(True))
    return rewrite(spark, path, by, lambda t: t.join(keys.select(key), key, "left_semi"), lambda rows: update_where(rows.join(own, key, "left"), F.col("_hit"), values))


def delete_stored(spark: SparkSession, path: str, by: list[str], keys: DataFrame, key: str) -> int:
    """Rows whose key is in `keys` go."""
    return rewrite(spark, path, by, lambda t: t.join(keys.select(key), key, "left_semi"), lambda rows: rows.join(keys.select(key).distinct(), key, "left_anti"))


def delete_stored_where(spark: SparkSession, path: str, by: list[str], where: Column) -> int:
    """Rows for which `where` is true go; null counts as false."""
    return rewrite(spark, path, by, lambda t: t.filter(where), lambda rows: rows.filter(~F.coalesce(where, F.lit(False))))


def update_stored_where(spark: SparkSession, path: str, by: list[str], where: Column, values: dict[str, Column]) -> int:
    """Rows for which `where` is true get the values, as an update by LIKE does."""
    if moved := set(values) & set(by):
        raise ValueError(f"an update can't move rows to other partitions: {', '.join(sorted(moved))}")
    return rewrite(spark, path, by, lambda t: t.filter(where), lambda rows: update_where(rows, where, values))


class StoredTable(NamedTuple):
    """Where a table is, by which columns it is partitioned, and its key."""

    path: str
    by: list[str]
    key: str = "id"


def delete_cascade(spark: SparkSession, tables: dict[str, StoredTable], references: list[Reference], doomed: dict[str, DataFrame]) -> dict[str, int]:
    """Deletes the rows of `doomed` (table to rows with its keys) with all that goes with them, and makes other references to them null; rewritten partitions per table.

    What goes is found first, from the tables as they are, and written as keys; then each table is rewritten, children before parents, so that a stop leaves no child
    without its parent and the same call can be made again.
    """
    read = {name: spark.read.parquet(t.path) for name, t in tables.items()}
    gone = going(read, references, doomed, kept)
    done = dict.fromkeys(tables, 0)
    for name in [n for n in reversed(in_order(references)) if n in tables]:
        t = tables[name]
        for r in (r for r in references if r.child == name and r.parent in gone):
            keys = gone[r.parent].select(F.col(r.key).alias(r.column)).dropna().distinct()
            if r.cascade:
                done[name] += delete_stored(spark, t.path, t.by, keys, r.column)
            else:
                done[name] += update_stored(spark, t.path, t.by, keys, r.column, {r.column: F.lit(None)})
        if name in doomed:
            done[name] += delete_stored(spark, t.path, t.by, doomed[name].select(t.key), t.key)
    return done
