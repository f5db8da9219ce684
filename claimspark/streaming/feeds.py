"""The feed of finding changes as streams: inserts of a project, and a count of open severe findings kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimspark.sources.shared import send_code

FEED = "op string, seq bigint, id bigint, severity string, status string"
#: How many numbers (seq) a change may come behind the newest one.
REMEMBERED = 10_000_000


def replayed(rows: DataFrame, folder: str) -> DataFrame:
    """What a stream in append mode gives until all that is there has been read, as a table in the folder."""
    name = f"feed_{uuid.uuid4().hex}"
    out = rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True)
    out.format("parquet").start(f"{folder}/{name}").awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


def read_feed(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def inserts(feed: DataFrame) -> DataFrame:
    """New findings only; append mode."""
    return feed.filter(F.col("op") == "INSERT").drop("op")


def insert_counts(feed: DataFrame) -> DataFrame:
    """Running counts of inserts by severity; complete or update mode."""
    return inserts(feed).groupBy("severity").agg(F.count("*").alias("n"))


class _OpenHigh(StatefulProcessor):
    """State of a finding: its last seq, and whether it counts. Of one that doesn't count the state ends when a timer says so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "seq bigint, counts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        seq, counts = self.last.get() if self.last.exists() else (-1, 0)
        before, was = counts, seq
        for b in rows:
            last = b.iloc[b["seq"].to_numpy().argmax()]
            if last["seq"] > seq:
                seq, counts = int(last["seq"]), int(last["op"] != "DELETE" and last["status"] == "OPEN" and last["severity"] == "HIGH")
        if seq > was:
            self.last.update((seq, counts))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not counts:
                self.handle.registerTimer(seq + 1)
        yield pd.DataFrame({"id": [key[0]] if counts != before else [], "delta": [counts - before] if counts != before else []}).astype({"id": "int64", "delta": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"id": [], "delta": []}).astype("int64")

    def close(self) -> None:
        pass


def open_high_changes(feed: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """(id, delta): findings that come to count as open and severe (+1), or no longer do (-1); the sum of deltas is the present number. Append mode.

    Keyed state holds two numbers of each finding that counts, and of the others only while changes older than their last may still come: the feed's clock is
    seq, its watermark stands `remembered` numbers behind the newest change, and changes from before it are left out. So state grows with the open severe findings and the
    `remembered` last changes, not with all findings that ever were.
    """
    spark = feed.sparkSession
    send_code(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state with timers needs it
    timed = feed.withColumn("_at", F.timestamp_millis("seq")).withWatermark("_at", f"{remembered} milliseconds")
    return timed.groupBy("id").transformWithStateInPandas(_OpenHigh(), "id bigint, delta bigint", "Append", "EventTime")
