"""Notes that govern items: the nearest one before an item, and all under the prefixes of its code. Equi joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scalars import first_segments, segments
from claimspark.sources.shared import kept

from .carry import carried


def _order() -> list:
    return [F.asc_nulls_first("item_code"), F.asc_nulls_first("id")]


def positions(items: DataFrame, list_key: str = "pricelist_id", ranges: int | None = None) -> DataFrame:
    """items with `pos`, their place by code and id in their list. A list of any length is dealt out by ranges; ids are unique in it."""
    return carried(items, [list_key], _order(), kept, place="pos", ranges=ranges)


def governing_notes(items: DataFrame, list_key: str = "pricelist_id", ranges: int | None = None) -> DataFrame:
    """(list, id, note_id) of each plain item: the nearest note before it, by code and id, whose first two segments begin its code; else null.

    The string prefixes of an item's code that are as long as some note's meet the notes by equality. Notes of a prefix are put among
    the items in order, and the last one is carried from row to row and from range to range: its cost is linear, not items times notes, and
    a prefix that holds a whole list (that of an empty code) is dealt out like any other.
    """
    code = F.col("item_code")
    none = F.lit(None).cast("bigint")
    notes = items.filter(F.col("item_type") == "NOTE").select(list_key, first_segments(code, 2).alias("prefix"), "item_code", "id", F.lit(True).alias("is_note"))
    used = notes.groupBy(list_key, "prefix").agg(F.lit(True).alias("_used"))
    lengths = used.agg(F.collect_set(F.length("prefix"))).scalar()  # few: codes are short
    prefixes = F.transform(F.filter("_lengths", lambda n: n <= F.length(code)), lambda n: F.substring(code, F.lit(1), n))
    plain = items.filter(F.col("item_type") == "ITEM").withColumn("_lengths", lengths).select(list_key, F.explode(prefixes).alias("prefix"), "item_code", "id", F.lit(False).alias("is_note")).join(used, [list_key, "prefix"], "left_semi")
    note = F.when(F.col("is_note"), F.struct("item_code", "id"))
    met = carried(plain.unionByName(notes), [list_key, "prefix"], _order(), kept, last={"near": note}, ranges=ranges).filter("not is_note and near is not null")
    nearest = met.groupBy(list_key, "id").agg(F.max("near")["id"].alias("note_id"))
    return items.filter(F.col("item_type") == "ITEM").select(list_key, "id").join(nearest, [list_key, "id"], "left").select(list_key, "id", F.coalesce("note_id", none).alias("note_id"))


def governing_notes_by_prefix(items: DataFrame, list_key: str = "pricelist_id", ranges: int | None = None) -> DataFrame:
    """As governing_notes where each note's two segments are the item's own: no join of items with notes."""
    rows = items.filter(F.col("item_type").isin("ITEM", "NOTE")).select(list_key, first_segments(F.col("item_code"), 2).alias("prefix"), "item_code", "id", "item_type")
    seen = carried(rows, [list_key, "prefix"], _order(), kept, last={"note_id": F.when(F.col("item_type") == "NOTE", F.col("id"))}, ranges=ranges)
    return seen.filter(F.col("item_type") == "ITEM").select(list_key, "id", "note_id")


def parent_prefixes(items: DataFrame, *keys: str) -> DataFrame:
    """Distinct prefixes of one, two and three segments of the codes, of which no more than the code has."""
    code, n = F.col("item_code"), F.size(segments(F.col("item_code")))
    each = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(3))), lambda k: F.array_join(F.slice(segments(code), F.lit(1), k), "."))
    return items.filter(code != "").select(*keys, F.explode(F.array_distinct(each)).alias("prefix")).filter("prefix <> ''").distinct()


def notes_under(notes: DataFrame, prefixes: DataFrame, *keys: str, boundary: str = "string") -> DataFrame:
    """notes whose code begins with one of the prefixes, case-insensitively; `boundary='segment'` wants whole segments.

    Each note's own prefixes are exploded and met by equality, so the join is a hash or merge join.
    """
    code = F.lower("item_code")
    if boundary == "segment":
        own = F.transform(F.sequence(F.lit(1), F.size(segments(code))), lambda n: F.array_join(F.slice(segments(code), F.lit(1), n), "."))
    else:
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), lambda n: F.substring(code, F.lit(1), n))
    lowered = prefixes.select(*keys, F.lower("prefix").alias("_p")).distinct()
    hit = notes.select(*dict.fromkeys([*keys, "id"]), F.explode(own).alias("_p")).join(lowered, [*keys, "_p"], "left_semi").select(*dict.fromkeys([*keys, "id"])).distinct()
    return notes.join(hit, list(dict.fromkeys([*keys, "id"])), "left_semi")
