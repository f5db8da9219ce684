"""Sinks that may see a batch twice: what a batch writes is named by its number, so that a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimspark.operators.ledger import KPI_AMOUNTS, KPI_COUNTS, kpi_parts, kpis_of


#: Money that a batch adds.
ADDED = "decimal(28,2)"


def _put(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def each_batch_once(rows: DataFrame, path: str, tables: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str | None = None) -> StreamingQuery:
    """Writes of each batch of a stream what `tables` makes of it, to path/<name>/batch=<number>; reads all that is there, then ends.

    The tables of a batch are written one after the other. If a run stops between them, the stream repeats the batch with the same
    rows and the same number, and its folders are written anew: nothing is counted twice and nothing is lost. Only for several tables is a batch kept: rows that
    are kept are many times their files, and a task reads all that another one has kept of its files.
    """
    several = len(tables) > 1

    def write(batch: DataFrame, number: int) -> None:
        if several:
            batch.persist()
        for name, of in tables.items():
            _put(of(batch), f"{path}/{name}", number)
        if several:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}/_checkpoint").trigger(availableNow=True).start()


def table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """What the batches have written, without their numbers."""
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").drop("batch")


def counted_inserts(feed: DataFrame, path: str) -> StreamingQuery:
    """New findings in path/rows, and beside them what each batch adds to their counts by severity in path/counts."""
    new = feed.filter(F.col("op") == "INSERT").drop("op")
    return each_batch_once(new, path, {"rows": lambda b: b, "counts": lambda b: b.groupBy("severity").agg(F.count("*").alias("n"))})


def running_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts up to the last batch that was written: a row a severity, from small tables."""
    return table(spark, path, "counts", "severity string, n bigint").groupBy("severity").agg(F.sum("n").alias("n"))


def signed(changes: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """What changes of rows (op, old, new: structs of a row, null where there is none) add to sums: per keys, the values of new rows less those of old ones."""
    of = lambda row, sign: F.when(F.col(row).isNotNull(), F.struct(F.lit(sign).alias("sign"), F.col(row).alias("row")))
    each = changes.select(F.explode(F.filter(F.array(of("old", -1), of("new", 1)), lambda x: x.isNotNull())).alias("x")).select("x.sign", "x.row.*")
    return each.groupBy(*keys).agg(*[F.sum(F.col("sign") * v).alias(name) for name, v in values.items()])


def ledger_deltas(changes: DataFrame, path: str) -> StreamingQuery:
    """Of a stream of ledger changes (old, new: ledger rows with amounts) what each batch adds to its projects' KPI sums, in path/sums."""
    def sums(batch: DataFrame) -> DataFrame:
        return signed(batch, ["project_id"], kpi_parts()).withColumns({c: F.col(c).cast(ADDED) for c in KPI_AMOUNTS})

    return each_batch_once(changes, path, {"sums": sums})


def streamed_kpis(spark: SparkSession, path: str, projects: DataFrame) -> DataFrame:
    """KPIs as of the last batch: what batches added is summed, the ledger is not read. They equal `ledger.kpis` of the ledger after all changes."""
    kinds = ", ".join([f"{c} {ADDED}" for c in KPI_AMOUNTS] + [f"{c} bigint" for c in KPI_COUNTS])
    added = table(spark, path, "sums", f"project_id bigint, {kinds}")
    return kpis_of(added.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in (*KPI_AMOUNTS, *KPI_COUNTS)]), projects)
