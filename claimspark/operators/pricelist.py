"""Price lists: typed rows of a sheet, item types by three rules, segment statistics, code shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.fixed import NOTE_WORDS
from claimspark.functions.scalars import any_of, first_segments, has_number, has_text, parse_float, segments, text_or, trimmed

SHEET = ["service_type", "item_code", "description", "activity_number", "quantity", "unit", "rate"]


def filled_rows(sheet: DataFrame, cells: list[str] | None = None) -> DataFrame:
    """Rows with a cell behind the first one: a row's length is its last filled cell."""
    return sheet.filter(F.coalesce(*[F.col(c) for c in (cells or sheet.columns)[1:]]).isNotNull())


def typed_rows(sheet: DataFrame) -> DataFrame:
    """Seven text columns by position as named, typed ones. Null is empty; numbers are the prefixes of their cells; empty units are null."""
    c = [F.col(x) for x in sheet.columns[:7]]
    empty = F.lit("")
    return sheet.select(
        text_or(c[0], empty).alias("service_type"), text_or(c[1], empty).alias("item_code"), text_or(c[2], empty).alias("description"), text_or(c[3], empty).alias("activity_number"),
        parse_float(c[4]).cast("decimal(12,2)").alias("quantity"), trimmed(c[5]).alias("unit"), parse_float(c[6]).cast("decimal(15,2)").alias("rate"), *sheet.columns[7:],
    )


def type_by_loader(code: Column) -> Column:
    """Any trailing dots are a heading: three a chapter, fewer a sub-chapter."""
    return F.when(code.endswith("..."), "CHAPTER").when(code.endswith("."), "SUBCHAPTER").otherwise("ITEM")


def type_by_repair(code: Column) -> Column:
    """Two or three trailing dots are a chapter, one a sub-chapter; a null code has no type."""
    return F.when(code.like("%.."), "CHAPTER").when(code.like("%."), "SUBCHAPTER").when(code.isNotNull(), "ITEM")


def type_with_notes(code: Column, description: Column, unit: Column, rate: Column, words: list[str] = NOTE_WORDS) -> Column:
    """Headings by dots; notes by a word in the description, or by a missing price and unit. A chapter is one even with a note word."""
    code, description = F.coalesce(code, F.lit("")), F.coalesce(description, F.lit(""))
    unpriced = ~has_number(rate) & ~has_text(unit)
    note = (any_of(description, words) if words else F.lit(False)) | (unpriced & (F.length(description) > 15))
    heading = F.when(note, "NOTE").otherwise("SUBCHAPTER")
    return F.when(code.endswith("..."), "CHAPTER").when(code.endswith("."), heading).when(note | (unpriced & (code != "")), "NOTE").otherwise("ITEM")


def classified(items: DataFrame) -> DataFrame:
    code = F.col("item_code")
    return items.withColumns({"loader_type": type_by_loader(code), "repair_type": type_by_repair(code), "item_type": type_with_notes(code, F.col("description"), F.col("unit"), F.col("rate"))})


def segment_counts(items: DataFrame, *keys: str) -> DataFrame:
    """Rows and distinct two-segment codes per first segment."""
    code = F.col("item_code")
    by_two = items.groupBy(*keys, segments(code)[0].alias("chapter"), first_segments(code, 2).alias("_two")).agg(F.count("*").alias("n"))
    return by_two.groupBy(*keys, "chapter").agg(F.sum("n").cast("bigint").alias("n_items"), F.count("*").alias("n_subchapters"))


def code_shapes(items: DataFrame, target: str) -> DataFrame:
    """Flags of each code: a single trailing dot, dots of a chapter, the target with up to three dots, the target as a prefix."""
    code = F.col("item_code")
    return items.select("id", "item_code", code.rlike(r"(^|[^.])\.$").alias("one_dot"), code.contains("...").alias("chapter_dots"), code.isin(*[target + "." * n for n in range(4)]).alias("is_target"), code.startswith(target).alias("under_target"))


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """parents with n_items, 0 without children. Children are counted before the join."""
    n = children.groupBy(F.col("pricelist_id").alias(key)).agg(F.count("*").alias("n_items"))
    return parents.join(n, key, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("bigint"))


def page(items: DataFrame, number: int, size: int = 100) -> DataFrame:
    """One page by code, then id (binary order)."""
    return items.orderBy(F.asc_nulls_last("item_code"), "id").offset(number * size).limit(size)


def page_with_count(items: DataFrame, number: int, size: int = 100) -> DataFrame:
    """A page with the number of all rows beside it (a scalar subquery), and whether the page is full."""
    total = items.agg(F.count("*")).scalar()
    return page(items, number, size).withColumn("n_all", total).withColumn("has_more", F.col("n_all") >= (number + 1) * size)


def distinct_segments(items: DataFrame, *keys: str) -> DataFrame:
    """The first segments of the codes and under each its second ones, sorted."""
    code = F.col("item_code")
    pairs = items.filter(code != "").select(*keys, segments(code)[0].alias("chapter"), F.get(segments(code), F.lit(1)).alias("second")).distinct()
    return pairs.groupBy(*keys, "chapter").agg(F.array_join(F.array_sort(F.collect_set("second")), ",").alias("seconds"))  # two digits each


def items_of_model(response: DataFrame, column: str = "response") -> DataFrame:
    """Price-list rows from a text model's bill of quantities; missing values get defaults."""
    from claimspark.functions.scalars import strip_fences

    shape = "project_name string, items array<struct<item_code:string,description:string,type:string,unit:string,quantity:double,unit_price_excl_vat:double>>"
    rows = response.select(*[c for c in response.columns if c != column], F.explode(F.from_json(strip_fences(F.col(column)), shape)["items"]).alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        *[c for c in response.columns if c != column], text_or(F.col("i.item_code"), F.lit("")).alias("item_code"), text_or(F.col("i.description"), F.lit("")).alias("description"), text_or(F.col("i.type"), F.lit("ITEM")).alias("item_type"),
        text_or(F.col("i.unit"), F.lit("")).alias("unit"), zero(F.col("i.quantity")).cast("decimal(12,2)").alias("quantity"), zero(F.col("i.unit_price_excl_vat")).cast("decimal(15,2)").alias("rate"),
    )
