"""Files in and out: sheets as CSV or XLSX, binary documents, appended tables, exported text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.fixed import EXPORT_HEADERS
from claimspark.operators.documents import file_kind, mime_type
from claimspark.operators.pricelist import SHEET

from . import workbooks


def read_sheet(spark: SparkSession, path: str, header_rows: bool = True) -> DataFrame:
    """A sheet saved as CSV: seven text columns by position, quoted cells may hold line feeds."""
    return spark.read.csv(path, schema=", ".join(f"{c} string" for c in SHEET), header=header_rows, multiLine=True, escape='"')


def read_workbooks(spark: SparkSession, path: str, header_rows: bool = True) -> DataFrame:
    """The first sheet, by the workbook's own list, of each XLSX file under the path: its seven text columns by position, with `file` and `row_no`. A sheet is one task's work."""
    cells = workbooks.read(spark, path, sheets="first")
    rows = cells.filter("row_no > 0") if header_rows else cells
    return rows.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(SHEET)], "file", "row_no")


def sheet_head(sheet: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows that aren't blank: of workbooks by file and row number, of one CSV file in its order."""
    order = [c for c in ("file", "row_no") if c in sheet.columns]
    filled = sheet.dropna(how="all", subset=[c for c in sheet.columns if c not in order])
    return (filled.orderBy(*order) if order else filled).limit(rows)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, name, kind, mime, length, content). Files that are neither sheet, image nor PDF by their name are turned away."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower("name").rlike(r"\.(png|jpe?g|gif|webp|bmp|tiff?)$"), "image").otherwise(file_kind(F.col("name"), F.lit(None).cast("string")))
    return files.select("path", name.alias("name"), "length", "content").withColumn("kind", kind).filter("kind is not null").withColumn("mime", mime_type(F.col("name"), F.lit(None).cast("string")))


def sheet_census(spark: SparkSession, path: str, header_rows: bool = True) -> DataFrame:
    """Rows of each sheet file under the path."""
    return read_sheet(spark, path, header_rows).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("sheet")).agg(F.count("*").alias("n_rows"))


def write_head(rows: DataFrame, path: str, most: int = 5, order: list[str] | None = None) -> None:
    """The first rows, in an order if one is given, as JSON lines in one file."""
    (rows.orderBy(*order) if order else rows).limit(most).coalesce(1).write.mode("overwrite").json(path)


def with_model(files: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """files with `response`: answer(mime, base64 content) of each, called in tasks batch by batch. The model is the caller's."""
    @F.pandas_udf("string")
    def ask(mime: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([answer(m, c) for m, c in zip(mime, content, strict=True)])

    return files.withColumn("response", ask("mime", F.base64("content")))


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One job, all or nothing."""
    (rows.write.partitionBy(*partition_by) if partition_by else rows.write).mode("append").parquet(path)


def write_export(lines: DataFrame, path: str, project: object, key: str = "project_id", files: int | None = 1) -> None:
    """One project's export as a text file: byte-order mark, headers, then its lines in order. Without `files` as many files as Spark makes of it, in the order of their names."""
    first = lines.sparkSession.createDataFrame([(-1, 0, "\ufeff" + ",".join(EXPORT_HEADERS))], "section int, place bigint, line string")
    own = lines.filter(F.col(key) == F.lit(project)).select("section", "place", "line")
    first.unionByName(own).repartitionByRange(*([files] if files else []), "section", "place").sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)
