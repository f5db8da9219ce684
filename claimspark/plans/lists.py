"""Price-list queries: types, segments, notes, search, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from claimspark.functions import fixed as X, scalars as S
from claimspark.operators import changes, hierarchy, pages, pricelist, search, trigrams
from claimspark.sources import views as V
from claimspark.sources.shared import kept

from .money import TYPED

WORDS = ["ring", "wid%et"]
KEY = ["letter_id", "line_no", "item_id", "created_at", "total_price_excl_vat", "quantity"]
ITEMS = f"WITH {V.ITEMS_SQL} "
CLASSIFIED = f"WITH {V.ITEMS_SQL}, {TYPED}, classified AS (SELECT items.*, item_type FROM items JOIN typed ON id = item_id) "
POSITIONS = CLASSIFIED + ", placed AS (SELECT *, row_number() OVER (PARTITION BY pricelist_id ORDER BY item_code, id) AS pos, array_to_string(list_slice(string_split(item_code, '.'), 1, 2), '.') AS prefix FROM classified) "
PREFIXES = "prefixes AS (SELECT DISTINCT pricelist_id, array_to_string(list_slice(string_split(item_code, '.'), 1, n), '.') AS prefix FROM classified, (VALUES (1), (2), (3)) t(n) WHERE item_type = 'ITEM')"


def _classified(spark, sf):
    return pricelist.classified(V.items(spark, sf))


def items_classified(spark, sf):
    return _classified(spark, sf).select("id", "item_code", "loader_type", "repair_type", "item_type")


def sheet_rows(spark, sf):
    """A sheet's text cells, some with text behind the number, some empty."""
    p, k = V.table(spark, sf, "part"), F.col("p_partkey")
    text = F.when(k % 13 == 0, None).otherwise(F.col("p_name"))
    sheet = p.select(F.col("p_brand").alias("a"), F.when(k % 13 != 0, F.concat(k.cast("string"), F.lit("."))).alias("b"), text.alias("c"), F.when(k % 3 == 0, "7").alias("d"), F.when(k % 13 != 0, F.concat((k % 50).cast("string"), F.lit(".5 pcs"))).alias("e"), F.when(k % 4 == 0, "  ").when(k % 13 != 0, " u ").alias("f"), F.when(k % 5 == 0, "n/a").when(k % 13 != 0, F.concat(F.lit(" "), (k % 90).cast("string"), F.lit(".25"))).alias("g"), k.alias("id"))
    cells = pricelist.SHEET
    return pricelist.typed_rows(pricelist.filled_rows(sheet.toDF(*cells, "id"), pricelist.SHEET))


def segment_counts(spark, sf):
    return pricelist.segment_counts(V.items(spark, sf), "pricelist_id")


def code_shapes(spark, sf):
    return pricelist.code_shapes(V.items(spark, sf), "05")


def pricelist_counts(spark, sf):
    lists = V.table(spark, sf, "part").select(F.col("p_brand").alias("id")).distinct().unionByName(spark.createDataFrame([("empty list",)], "id string"))
    return pricelist.child_counts(lists, V.items(spark, sf).filter("rate > 1000"), "id")


def pricelist_page(spark, sf):
    return pricelist.page(V.items(spark, sf).select("id", "item_code", "description"), 1)


def findings_deep_page(spark, sf):
    """A page far behind the first, from the range that holds it."""
    rows = V.findings(spark, sf).select("created_at", "id", "title")
    return pages.page_with_count(rows, pages.ranges(rows, ["created_at", "id"]), 12)


def findings_next_page(spark, sf):
    """The page behind the last row of the one before."""
    rows = V.findings(spark, sf).select("created_at", "id", "title")
    seen = pages.page(rows, pages.ranges(rows, ["created_at", "id"]), 11).collect()
    return pages.next_page(rows, ["created_at", "id"], seen[-1])


def trigram_search(spark, sf):
    """Words with and without wildcards, taken as they are, and one that is too short for a trigram, through one table of trigrams."""
    rows = V.items(spark, sf)
    table = trigrams.postings(rows, "id", ["description", "item_code"], kept)
    asked = {"words": (WORDS, False), "as they are": ([*WORDS, "01.01"], True), "short": (["RI", "x%y%z"], False), "nowhere": (["no such words"], False)}
    found = [trigrams.search(rows, table, "id", ["description", "item_code"], words, escape).select(F.lit(name).alias("asked"), "id") for name, (words, escape) in asked.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


def search_box(spark, sf):
    return search.search_box(_classified(spark, sf), "WIDGET").select("id", "item_type")


def keyword_search(spark, sf):
    return V.items(spark, sf).filter(S.any_ilike([F.col("description")], WORDS)).select("id", "description")


def keyword_tokens(spark, sf):
    f = V.findings(spark, sf)
    return f.select("id", F.array_join(search.keywords(F.concat(F.lit("re-do, a x.y "), "title")), "|").alias("keywords"))


def governing_notes(spark, sf):
    return hierarchy.governing_notes(_classified(spark, sf))


def governing_notes_by_prefix(spark, sf):
    return hierarchy.governing_notes_by_prefix(_classified(spark, sf))


def parent_notes(spark, sf):
    items = _classified(spark, sf)
    prefixes = hierarchy.parent_prefixes(items.filter("item_type = 'ITEM'"), "pricelist_id")
    return hierarchy.notes_under(items.filter("item_type = 'NOTE'"), prefixes, "pricelist_id").select("pricelist_id", "id", "item_code")


def notes_with_hits(spark, sf):
    """Hits of a word with the notes over them, each id once."""
    items = _classified(spark, sf).select("id", "item_code", "item_type", "description")
    hits = items.filter(F.col("item_type").isin("ITEM", "NOTE") & S.any_ilike([F.col("description")], ["ring"]))
    notes = hierarchy.notes_under(items.filter("item_type = 'NOTE'"), hierarchy.parent_prefixes(hits.filter("item_type = 'ITEM'")))
    return changes.union_first(hits, notes, "id").select("id", "item_type")


def price_search(spark, sf):
    return search.price_search(V.ledger(spark, sf), _classified(spark, sf), WORDS, KEY)


def price_priority(spark, sf):
    """Each finding's price: the contract's lines first, then the standard list, else none."""
    f = V.findings(spark, sf).select("id")
    rates = V.items(spark, sf).filter("rate > 0").select(F.col("id").alias("item_id"), "rate")
    lines = V.ledger(spark, sf).select(F.col("letter_id").alias("id"), "item_id", "type", "source", "unit_price_excl_vat").join(rates, "item_id", "left")  # once for both sources
    candidate = lambda source, price: F.struct(source.alias("source"), F.col(price).alias("price"), F.col("item_id").cast("string").alias("item_code"))
    both = F.array(F.when(F.col("type") == "BASE_CONTRACT", candidate(F.col("source"), "unit_price_excl_vat")), F.when(F.col("rate").isNotNull(), candidate(F.lit("DEKEL"), "rate")))
    return search.best_source(f, lines.select("id", F.explode(F.filter(both, lambda c: c.isNotNull())).alias("c")).select("id", "c.*"), "id")


QUERIES = {
    "items_classified": (items_classified, CLASSIFIED + "SELECT id, item_code, CASE WHEN item_code LIKE '%...' THEN 'CHAPTER' WHEN item_code LIKE '%.' THEN 'SUBCHAPTER' ELSE 'ITEM' END AS loader_type, CASE WHEN item_code LIKE '%..' THEN 'CHAPTER' WHEN item_code LIKE '%.' THEN 'SUBCHAPTER' ELSE 'ITEM' END AS repair_type, item_type FROM classified"),
    "sheet_rows": (sheet_rows, """SELECT p_brand AS service_type, CASE WHEN k % 13 <> 0 THEN k || '.' ELSE '' END AS item_code, CASE WHEN k % 13 = 0 THEN '' ELSE p_name END AS description, CASE WHEN k % 3 = 0 THEN '7' ELSE '' END AS activity_number,
  CAST(CASE WHEN k % 13 <> 0 THEN CAST((k % 50) || '.5' AS DOUBLE) ELSE 0 END AS DECIMAL(12,2)) AS quantity, CASE WHEN k % 4 <> 0 AND k % 13 <> 0 THEN 'u' END AS unit, CAST(CASE WHEN k % 5 = 0 OR k % 13 = 0 THEN 0 ELSE CAST((k % 90) || '.25' AS DOUBLE) END AS DECIMAL(15,2)) AS rate, k AS id
  FROM (SELECT *, p_partkey AS k FROM part) WHERE NOT (k % 13 = 0 AND k % 3 <> 0 AND k % 4 <> 0 AND k % 5 <> 0)"""),
    "segment_counts": (segment_counts, ITEMS + "SELECT pricelist_id, string_split(item_code, '.')[1] AS chapter, count(*) AS n_items, count(DISTINCT array_to_string(list_slice(string_split(item_code, '.'), 1, 2), '.')) AS n_subchapters FROM items GROUP BY 1, 2"),
    "code_shapes": (code_shapes, ITEMS + r"SELECT id, item_code, item_code LIKE '%.' AND item_code NOT LIKE '%..' AS one_dot, contains(item_code, '...') AS chapter_dots, item_code IN ('05', '05.', '05..', '05...') AS is_target, starts_with(item_code, '05') AS under_target FROM items"),
    "pricelist_counts": (pricelist_counts, ITEMS + "SELECT l.id, coalesce(n, 0) AS n_items FROM (SELECT DISTINCT p_brand AS id FROM part UNION ALL SELECT 'empty list') l LEFT JOIN (SELECT pricelist_id, count(*) AS n FROM items WHERE rate > 1000 GROUP BY 1) c ON l.id = c.pricelist_id"),
    "pricelist_page": (pricelist_page, ITEMS + "SELECT id, item_code, description FROM items ORDER BY item_code, id LIMIT 100 OFFSET 100"),
    "findings_deep_page": (findings_deep_page, f"WITH {V.FINDINGS_SQL} SELECT created_at, id, title, (SELECT count(*) FROM findings) AS n_all, (SELECT count(*) FROM findings) >= 1300 AS has_more FROM findings ORDER BY created_at, id LIMIT 100 OFFSET 1200"),
    "findings_next_page": (findings_next_page, f"WITH {V.FINDINGS_SQL} SELECT created_at, id, title FROM findings ORDER BY created_at, id LIMIT 100 OFFSET 1200"),
    "trigram_search": (trigram_search, ITEMS + " UNION ALL ".join(f"SELECT '{name}' AS asked, id FROM items WHERE " + " OR ".join(f"{c} ILIKE '%{w}%' {e}" for w in words for c in ("description", "item_code")) for name, words, e in [("words", WORDS, ""), ("as they are", ["ring", r"wid\%et", "01.01"], r"ESCAPE '\'"), ("short", ["RI", "x%y%z"], ""), ("nowhere", ["no such words"], "")])),
    "search_box": (search_box, CLASSIFIED + "SELECT id, item_type FROM classified WHERE description ILIKE '%widget%' OR item_code ILIKE '%widget%' OR item_type = 'NOTE'"),
    "keyword_search": (keyword_search, ITEMS + "SELECT id, description FROM items WHERE description ILIKE '%ring%' OR description ILIKE '%wid%et%'"),
    "keyword_tokens": (keyword_tokens, f"WITH {V.FINDINGS_SQL} SELECT id, array_to_string(list_slice(list_filter(regexp_split_to_array('re-do, a x.y ' || title, '[\\s,.-]+'), lambda w: length(w) > 2), 1, 4), '|') AS keywords FROM findings"),
    "governing_notes": (governing_notes, POSITIONS + "SELECT i.pricelist_id, i.id, n.note_id FROM placed i LEFT JOIN (SELECT i.id AS item, max_by(n.id, n.pos) AS note_id FROM placed i JOIN placed n ON n.pricelist_id = i.pricelist_id AND n.item_type = 'NOTE' AND i.item_type = 'ITEM' AND n.pos < i.pos AND starts_with(i.item_code, n.prefix) GROUP BY 1) n ON i.id = n.item WHERE i.item_type = 'ITEM'"),
    "governing_notes_by_prefix": (governing_notes_by_prefix, POSITIONS + "SELECT i.pricelist_id, i.id, n.note_id FROM placed i LEFT JOIN (SELECT i.id AS item, max_by(n.id, n.pos) AS note_id FROM placed i JOIN placed n ON n.pricelist_id = i.pricelist_id AND n.item_type = 'NOTE' AND i.item_type = 'ITEM' AND n.pos < i.pos AND i.prefix = n.prefix GROUP BY 1) n ON i.id = n.item WHERE i.item_type = 'ITEM'"),
    "parent_notes": (parent_notes, CLASSIFIED + f", {PREFIXES} SELECT pricelist_id, id, item_code FROM classified c WHERE item_type = 'NOTE' AND EXISTS (SELECT 1 FROM prefixes p WHERE p.pricelist_id = c.pricelist_id AND starts_with(lower(c.item_code), lower(p.prefix)))"),
    "notes_with_hits": (notes_with_hits, CLASSIFIED + """, hits AS (SELECT * FROM classified WHERE item_type IN ('ITEM', 'NOTE') AND description ILIKE '%ring%'), prefixes AS (SELECT DISTINCT array_to_string(list_slice(string_split(item_code, '.'), 1, n), '.') AS prefix FROM hits, (VALUES (1), (2), (3)) t(n) WHERE item_type = 'ITEM')
SELECT id, item_type FROM hits UNION SELECT id, item_type FROM classified c WHERE item_type = 'NOTE' AND EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(c.item_code, p.prefix))"""),
    "price_search": (price_search, f"""WITH {V.LEDGER_SQL}, {V.ITEMS_SQL}, {TYPED}, classified AS (SELECT items.*, item_type FROM items JOIN typed ON id = item_id),
contract AS (SELECT * FROM ledger WHERE type = 'BASE_CONTRACT' AND (description ILIKE '%ring%' OR description ILIKE '%wid%et%') ORDER BY {", ".join(KEY)} LIMIT 30),
hits AS (SELECT * FROM classified WHERE item_type IN ('ITEM', 'NOTE') AND (description ILIKE '%ring%' OR description ILIKE '%wid%et%') ORDER BY id LIMIT 50),
prefixes AS (SELECT DISTINCT array_to_string(list_slice(string_split(item_code, '.'), 1, n), '.') AS prefix FROM hits, (VALUES (1), (2), (3)) t(n) WHERE item_type = 'ITEM'),
notes AS (SELECT * FROM classified c WHERE item_type = 'NOTE' AND EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(c.item_code, p.prefix)) ORDER BY id LIMIT 40),
found AS (SELECT * FROM hits UNION ALL SELECT * FROM notes WHERE id NOT IN (SELECT id FROM hits))
SELECT 'CONTRACT ITEM' AS tag, {" || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in KEY)} AS ref, description FROM contract UNION ALL SELECT CASE WHEN item_type = 'NOTE' THEN 'GOVERNING NOTE' ELSE 'EXTERNAL ITEM' END, CAST(id AS VARCHAR), description FROM found"""),
    "price_priority": (price_priority, f"""WITH {V.LEDGER_SQL}, {V.ITEMS_SQL}, {V.FINDINGS_SQL}, c AS (SELECT letter_id AS id, 'BOQ' AS source, 0 AS rank, unit_price_excl_vat AS price, CAST(item_id AS VARCHAR) AS item_code FROM ledger WHERE type = 'BASE_CONTRACT'
  UNION ALL SELECT letter_id, 'DEKEL', 1, rate, CAST(item_id AS VARCHAR) FROM ledger JOIN items ON item_id = items.id WHERE rate > 0), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, price, item_code) AS n FROM c)
SELECT f.id, b.id IS NOT NULL AS match_found, coalesce(b.source, 'CUSTOM_ANALYSIS') AS source, CAST(coalesce(price, 0) AS DECIMAL(15,2)) AS price, item_code FROM findings f LEFT JOIN (SELECT * FROM best WHERE n = 1) b ON f.id = b.id"""),
}
