"""Price search: keywords, hits in the ledger and the price lists, parents' notes, and the best source of a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.fixed import LEDGER_SOURCES
from claimspark.functions.scalars import any_ilike, ordinal

from .hierarchy import notes_under, parent_prefixes

KEYWORDS, LEDGER_HITS, LIST_HITS, NOTE_HITS = 4, 30, 50, 40


def keywords(title: Column, most: int = KEYWORDS) -> Column:
    """The first words of more than two characters, between blanks, commas, dots and hyphens."""
    return F.slice(F.filter(F.transform(F.split(title, r"[\s,.-]+", -1), lambda w: F.trim(w)), lambda w: F.length(w) > 2), 1, most)


def ledger_hits(ledger: DataFrame, words: list[str], key: list[str], most: int = LEDGER_HITS) -> DataFrame:
    return ledger.filter((F.col("type") == "BASE_CONTRACT") & any_ilike([F.col("description")], words)).orderBy(*key).limit(most)


def list_hits(items: DataFrame, words: list[str], most: int = LIST_HITS) -> DataFrame:
    return items.filter(F.col("item_type").isin("ITEM", "NOTE") & any_ilike([F.col("description"), F.col("item_code")], words)).orderBy("id").limit(most)


def search_box(items: DataFrame, word: str) -> DataFrame:
    """Items with the word in text or code; notes always stay."""
    return items.filter(any_ilike([F.col("description"), F.col("item_code")], [word], escape=True) | (F.col("item_type") == "NOTE"))


def with_parent_notes(hits: DataFrame, items: DataFrame, most: int = NOTE_HITS) -> DataFrame:
    """hits and the notes over them, each id once; a hit's own row stands first."""
    notes = notes_under(items.filter(F.col("item_type") == "NOTE"), parent_prefixes(hits.filter(F.col("item_type") == "ITEM"))).orderBy("id").limit(most)
    return hits.unionByName(notes.join(hits.select("id"), "id", "left_anti").select(hits.columns))


def visible_to_project(items: DataFrame, lists: DataFrame, project: object) -> DataFrame:
    """Items of global lists and of the project's own."""
    own = lists.filter(F.coalesce(F.col("is_global"), F.lit(False)) | F.coalesce(F.col("project_id") == F.lit(project), F.lit(False)))
    return items.join(own.select(F.col("id").alias("pricelist_id")), "pricelist_id", "left_semi")


def project_notes(items: DataFrame, lists: DataFrame, project: object, most: int = 50) -> DataFrame:
    """Notes of the project's own lists with their list's name, the first by id."""
    own = lists.filter(F.col("project_id") == F.lit(project)).select(F.col("id").alias("pricelist_id"), F.col("name").alias("list_name"))
    return items.filter(F.col("item_type") == "NOTE").join(own, "pricelist_id").orderBy("id").limit(most).select("id", "item_code", "description", "list_name")


def with_questions(found: DataFrame, questions: list[str]) -> DataFrame:
    """Rows without a match get the questions to ask about them, others none."""
    return found.withColumn("questions", F.when(F.col("match_found"), F.array().cast("array<string>")).otherwise(F.array(*[F.lit(q) for q in questions])))


def price_search(ledger: DataFrame, items: DataFrame, words: list[str], key: list[str], lists: DataFrame | None = None, project: object | None = None) -> DataFrame:
    """(tag, ref, description): contract items, external items and governing notes for the words.

    With a project only its ledger counts, and with lists only items that it may see; notes over them are of any list.
    """
    ledger = ledger if project is None else ledger.filter(F.col("project_id") == F.lit(project))
    seen = items if lists is None else visible_to_project(items, lists, project)
    found = with_parent_notes(list_hits(seen, words), items)
    tag = F.when(F.col("item_type") == "NOTE", "GOVERNING NOTE").otherwise("EXTERNAL ITEM")
    contract = ledger_hits(ledger, words, key).select(F.lit("CONTRACT ITEM").alias("tag"), F.concat_ws("/", *key).alias("ref"), "description")
    return contract.unionByName(found.select(tag.alias("tag"), F.col("id").cast("string").alias("ref"), "description"))


def best_source(findings: DataFrame, candidates: DataFrame, key: str, override: str | None = None) -> DataFrame:
    """findings with the candidate (source, price, item_code) of the first source in order; of one source the cheapest, then least code.

    With `override` only that source counts. Without a candidate: no match, price 0, source CUSTOM_ANALYSIS. One aggregate, no sort.
    """
    allowed = candidates if override is None else candidates.filter(F.col("source") == override)
    best = allowed.groupBy(key).agg(F.min(F.struct(ordinal(F.col("source"), LEDGER_SOURCES).alias("rank"), "price", "item_code", "source")).alias("_b"))
    out = findings.join(best, key, "left")
    return out.select(*findings.columns, F.col("_b").isNotNull().alias("match_found"), F.coalesce("_b.source", F.lit("CUSTOM_ANALYSIS")).alias("source"), F.coalesce("_b.price", F.lit(0)).cast("decimal(15,2)").alias("price"), F.col("_b.item_code").alias("item_code"))


def first_per_group(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in an order that must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
