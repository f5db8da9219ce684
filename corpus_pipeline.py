"""A training corpus from `documents`: quality rules, line and document deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Columns of docs besides doc_id, text, lang and n_chars may have any name, also
one that an operator adds: all but the last stage return them as they are. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import decontam, linededup, neardup, pack, quality
from claimspark.llm.common import free, release, tidy
from claimspark.llm.queries import TOKENIZER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null and empty texts among them) or a certified rule of their language go; repeated rows are judged alike."""
    return quality.quality_filter(docs, _table(spark, sf_dir, "labels")).filter(F.col(free("_kept", docs.columns))).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated lines, and n_chars is counted again where there is one; documents of which no word is left, null and empty ones among them, go."""
    done = linededup.dedup_lines(docs, exact=1).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    counted = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
    return counted.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays; null and empty texts are alone, of rows that repeat an id all stay or go."""
    return neardup.drop_near_duplicates(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null and empty texts hold none."""
    return decontam.flag_contaminated(docs, _table(spark, sf_dir, "benchmark")).filter(F.col(free("_items", docs.columns)).isNull()).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of each document, in bins that hold op9's tokens; null and empty texts make one row without a bin. Only id and text are read."""
    import public_tokenizers

    return pack.pack_texts(docs, tokenizer=public_tokenizers.path(TOKENIZER)).drop("_row")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("best-fit packing", best_fit_packing)]
#: Token counts and packing have no SQL form; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`; each stage's are written as Parquet in the shared folder and read again, and removed once the next one's are."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = tidy(stage)(spark, docs, sf_dir)
        release(docs)
        docs = kept
    return docs
