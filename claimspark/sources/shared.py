"""Tables on the way, in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's spark.checkpoint.dir, or where all runs on one machine in a temporary one; removed when the program ends."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("executors need a folder that all of them share: set spark.checkpoint.dir")
        top = tempfile.gettempdir()
    path = f"{top}/claimspark-scratch-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a written table: read again as often as it is used, and made once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the largest table for which a query's shuffles get a partition.
ROWS_A_PARTITION = 500_000
#: Partitions up to which a table is small: whatever Spark broadcasts or joins of it is little memory of a task.
FEW = 12
#: Bytes of a side, as Spark estimates them, up to which it is broadcast on large tables: a broadcast table is memory of each task, and what is broadcast by default grows to a hundred times that.
BROADCAST_BYTES = 100_000
#: Shuffled bytes up to which AQE joins partitions there: rows are several times that in a task's memory.
JOINED_BYTES = 16_000_000


def _bytes(size: str) -> int:
    """Bytes of a setting such as 10485760b, 8m or -1."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def beside(spark: SparkSession, settings: dict[str, str | int]) -> SparkSession:
    """A session beside spark with the same settings, but for these."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in settings.items():
        own.conf.set(k, v)
    return own


#: Settings with which Parquet tables of whole numbers that mostly go up, or stay, row by row are written as differences: next to nothing a row, instead of a number's bytes. 20,000 rows, as pages have, are 4 KB then, and what ids repeat is found within a page.
AS_DIFFERENCES = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "200000"}


def sized(spark: SparkSession, rows: int, rows_a_partition: int = ROWS_A_PARTITION) -> SparkSession:
    """spark, if that many rows are few and its number of shuffle partitions is enough; else a session beside it with the same settings, as many partitions at least and smaller broadcasts.

    A number of partitions that is enough doesn't do by itself, as AQE joins partitions of any number up to its bytes. A task of a join, a sort or a window then has as many rows on large tables as on small ones. AQE still joins small partitions and splits hot ones, which it
    doesn't do to those of a repartition by number.
    """
    partitions, name = -(-rows // rows_a_partition), "spark.sql.shuffle.partitions"
    given = int(spark.conf.get(name))
    if partitions <= min(given, FEW):
        return spark
    smaller = {k: most for k, most in (("spark.sql.autoBroadcastJoinThreshold", BROADCAST_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED_BYTES)) if _bytes(spark.conf.get(k)) > most}
    return beside(spark, {name: max(partitions, given)} | smaller)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def has_folders(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder with folders in it, such as a table with partitions."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and any(f.isDirectory() and not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(where))


def send_code(spark: SparkSession) -> None:
    """Sends this package to the workers, once a context."""
    sc = spark.sparkContext
    if not hasattr(sc, "_claimspark_sent"):
        top = Path(__file__).resolve().parents[2]
        sc._claimspark_sent = tempfile.TemporaryDirectory(prefix="claimspark-code-")  # removed when the program ends
        sc.addPyFile(shutil.make_archive(f"{sc._claimspark_sent.name}/claimspark_code", "zip", top, "claimspark"))


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            remove(spark, path)
