"""The dealt operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, lexical, licenses, linededup, neardup, pack, pii, quality, secrets, simhash, sql, tokens
from .common import cut, spread, tidy

#: The tokenizer of op9; any other path can be given to the operator.
TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns that an operator reads, so that no other can be in its way."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", *columns, "text"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_documents(spark, sf_dir))
    base, labels = F.filter("matches", lambda m: m["phrase"]), lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


def _of_kind(kind: str):
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")


def _digest(spans) -> dict:
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return {"base_sha256": F.sha2(said("base_spans"), 256), "spans": said("spans")} | {f"n_{k}": _of_kind(k) for k in spans}


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_documents(spark, sf_dir))
    return found.select("doc_id", *[c.alias(k) for k, c in _digest(pii.KINDS).items()], F.size("spans").cast("bigint").alias("n_spans"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(_table(spark, sf_dir, "conversations"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir))
    return found.select("doc_id", *[c.alias(k) for k, c in _digest(secrets.KINDS).items()])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and their places, and the hash of what is left."""
    docs = _documents(spark, sf_dir).withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("bigint"))
    return linededup.dedup_lines(docs, exact=1).select("doc_id", "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(F.array_join(F.transform("_gone", lambda i: i.cast("string")), ","), F.lit("")).alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the benchmark items found in them."""
    found = decontam.flag_contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.filter("_items is not null").select("doc_id", F.array_join(F.transform("_items", lambda i: i.cast("string")), ",").alias("item_ids"), F.col("_hits").alias("n_hits"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.signals(_documents(spark, sf_dir, "lang")).drop("text")
    rated = quality.cut(rated)
    cutoffs = quality.cut(quality.certified_cutoffs(rated, _table(spark, sf_dir, "labels"), "lang"))
    return quality.judge(rated, cutoffs, "lang").select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("_kept").alias("kept"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir)).drop("row")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins hold op9's tokens."""
    import public_tokenizers

    return pack.pack_texts(_documents(spark, sf_dir), tokenizer=public_tokenizers.path(TOKENIZER)).drop("_row")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and hashes of each text's output, and of the text made again from it."""
    made = fim.fill_in_middle(_documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(_documents(spark, sf_dir))


@tidy
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(lexical.build_index(_documents(spark, sf_dir)))
    return lexical.search(index, _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_personal_data, op3_tool_calls, op4_secrets, op5_line_dedup, op6_decontamination, op7_quality_rules, op8_near_duplicates, op9_token_counts, op10_best_fit_packing, op11_fill_in_middle, op12_simhash, op13_lexical_search)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of the others, what they add (trees, schemas, tokens, packing) has no SQL form; tests compare with brute force."""
    return dict(sql.ALL)
