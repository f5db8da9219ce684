"""Helpers that the operators share: native text expressions, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word rules have it: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a side is broadcast after it has been counted; larger sides are shuffled.
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once for a row and hands it to `body`, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def blank_words(c: Column) -> Column:
    """Words between white space, in order; null text has none."""
    return F.filter(F.split(or_empty(c), BLANKS, -1), lambda w: w != "")


def row_key(doc_id: str, text: str) -> Column:
    """A 128-bit key of a row's id and text, null-safe: rows with equal ids and texts are one document."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")), F.lit("\1"), F.coalesce(F.col(text).cast("string"), F.lit("\0"))))


def free(name: str, *taken: list[str]) -> str:
    """`name`, with as many underscores behind it as it takes to be none of the columns `taken`."""
    have = {c.lower() for columns in taken for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, as in tests, a temporary one is set if all runs on one machine."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("executors need a folder that all of them share: set spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimspark-checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, so that a lost executor costs no earlier stage.

    Removed when the `tidy` function that makes it is done, else when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/claimspark-{uuid.uuid4().hex}"
    _written[path] = spark
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._claimspark_table = path
    return out


def release(df: DataFrame) -> None:
    """Removes the table of a `cut` that is not needed any more; other DataFrames stay as they are."""
    _remove(getattr(df, "_claimspark_table", ""))


def tidy(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`make` with its result cut, and all tables removed that were cut on the way to it."""

    @functools.wraps(make)
    def run(*args, **more):
        if not hasattr(_open, "scopes"):
            _open.scopes = []
        _open.scopes.append([])
        try:
            out = cut(make(*args, **more))
            kept = _open.scopes[-1].pop()
        finally:
            for path in _open.scopes.pop():
                _remove(path)
        if _open.scopes:
            _open.scopes[-1].append(kept)
        return out

    return run


_written: dict[str, SparkSession] = {}
_open = threading.local()


def _remove(path: str) -> None:
    if not (spark := _written.pop(path, None)):
        return
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        _remove(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as run at once, if it has fewer, as a file of one row group has; a table of more partitions stays as it is and isn't shuffled."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, items: Column | None = None) -> DataFrame:
    """A broadcast hint if df, which should be cheap to count, has at most `rows` narrow rows; else df as it is. items: how many narrow rows a row counts for."""
    n = df.limit(rows + 1).count() if items is None else df.agg(F.coalesce(F.sum(items), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df


def ready_for_arrow(spark: SparkSession, size: str = "2m") -> None:
    """Bounds Arrow batches by bytes, as texts can be long, and sends this package to the workers once a context."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    sc = spark.sparkContext
    if not hasattr(sc, "_claimspark_sent"):
        top = Path(__file__).resolve().parents[2]
        sc._claimspark_sent = tempfile.TemporaryDirectory(prefix="claimspark-code-")  # removed when the program ends
        sc.addPyFile(shutil.make_archive(f"{sc._claimspark_sent.name}/claimspark_llm", "zip", top, "claimspark"))


def give_back() -> None:
    """Returns memory that a worker has freed to the machine: workers live on, and other stages' come beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def with_arrow(df: DataFrame, keep: list[str], new: str, rows_of: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """df's columns `keep` plus those of the DDL `new`, from a function of whole batches; row by row, without a shuffle."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    added = to_arrow_schema(_parse_datatype_string(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = rows_of(b)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [x.cast(f.type) if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in added], schema=pa.schema([b.schema.field(k) for k in keep] + list(added)))
        give_back()

    ready_for_arrow(df.sparkSession)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.mapInArrow(run, f"{kinds}, {new}" if keep else new)
