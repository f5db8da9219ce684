"""Ledger queries: stored amounts, splits, KPIs, letters, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import fixed as X
from claimspark.operators import changes, ledger as L, letters
from claimspark.operators.pricelist import classified
from claimspark.sources import views as V


def ledger_generated(spark, sf):
    return V.ledger(spark, sf).select("project_id", "letter_id", "line_no", "item_id", "total_price_excl_vat", "vat_amount", "total_price_incl_vat")


def ledger_split(spark, sf):
    return L.split_by_contract(V.ledger(spark, sf), "project_id")


def ledger_kpis(spark, sf):
    return L.kpis(V.ledger(spark, sf), V.projects(spark, sf))


def vat_repaired(spark, sf):
    """A third of the rows are given the old rate first."""
    old = V.ledger(spark, sf).withColumn("vat_rate", F.when(F.col("line_no") % 3 == 0, F.lit(X.OLD_VAT_RATE).cast("decimal(5,4)")).otherwise(F.col("vat_rate")))
    fixed = L.repair_vat(L.with_amounts(old), X.OLD_VAT_RATE)
    return fixed.groupBy("project_id").agg(L.money_sum("vat_amount").alias("vat"), L.money_sum("total_price_incl_vat").alias("gross"))


def _letter_items(spark, sf):
    """Ledger rows with their item's code and type, and notes in several shapes."""
    typed = classified(V.items(spark, sf)).select(F.col("id").alias("item_id"), "item_code", "item_type")
    k = F.col("item_id") % 5
    notes = F.when(k == 0, '[{"text":"first"},{"page":2},"third"]').when(k == 1, '{"instruction":"do it"}').when(k == 2, '{"note":"see plan"}').when(k == 3, "plain words")
    return V.ledger(spark, sf).join(typed, "item_id").withColumn("governing_notes", notes)


def line_totals(spark, sf):
    return L.line_totals(_letter_items(spark, sf), "letter_id")


def selected_totals(spark, sf):
    """The rows of items with a note word are the selection."""
    chosen = V.items(spark, sf).filter(F.col("description").contains("בכפוף")).select(F.col("id").alias("item_id"))
    return L.selected_totals(V.ledger(spark, sf), chosen, "item_id")


def estimates(spark, sf):
    rows = V.items(spark, sf).select("id", (F.col("id") % 9 + 1).cast("decimal(12,2)").alias("quantity"), F.col("rate").alias("price"), F.when(F.col("id") % 4 == 0, 7).otherwise(X.DEFAULT_MARKUP_PERCENT).alias("markup_percent"))
    return L.estimates(rows).select("id", "net", "vat", "total")


ORDER = ["line_no", "item_id", "created_at", "total_price_excl_vat", "quantity", "unit_price_excl_vat"]


def letter_rows(spark, sf):
    rows = letters.letter_rows(_letter_items(spark, sf), "letter_id", ORDER)
    return rows.select("letter_id", "place", "part", *[F.col(c).alias(f"row_{c}") for c in letters.ROW])


def letter_headers(spark, sf):
    pending = V.ledger(spark, sf).filter("type = 'PENDING_VO'")
    return letters.letters(pending, "letter_id", ORDER, ["line_no", "item_id"])[0]


def letter_links(spark, sf):
    pending = V.ledger(spark, sf).filter("type = 'PENDING_VO'")
    return letters.letters(pending, "letter_id", ORDER, ["line_no", "item_id"])[1]


def ledger_types_after_letters(spark, sf):
    """Pending rows of open findings' letters become sent ones."""
    sent = V.findings(spark, sf).filter("status = 'OPEN'").select(F.col("id").alias("letter_id"))
    moved = changes.update_keys(V.ledger(spark, sf), sent, "letter_id", {"type": F.when(F.col("type") == "PENDING_VO", "SENT_VO").otherwise(F.col("type"))})
    return moved.groupBy("type").agg(F.count("*").alias("n"), L.money_sum("total_price_excl_vat").alias("net"))


def _exported(spark, sf):
    def complete(rows):
        coded = V.ledger_stated(rows).withColumn("item_code", F.when(F.col("item_id") % 3 > 0, F.col("item_id").cast("string"))).withColumn("markup_percentage", F.lit(0).cast("decimal(5,4)"))
        return coded.withColumn("description", F.concat("description", F.lit(' "x"')))

    return letters.export_rows(V.ledger_base(spark, sf).drop("ai_rationale"), tie=["letter_id", *ORDER], complete=complete)


def export_rows(spark, sf):
    return _exported(spark, sf)


def export_lines(spark, sf):
    return letters.csv_lines(_exported(spark, sf))


LEDGER = f"WITH {V.LEDGER_SQL} "
M = "DECIMAL(18,2)"


def _sum(x: str, when: str = "true") -> str:
    return f"CAST(coalesce(sum(CASE WHEN {when} THEN {x} END), 0) AS {M})"


NET = "CASE WHEN coalesce(total_price_excl_vat, 0) <> 0 THEN CAST(total_price_excl_vat AS DECIMAL(28,4)) ELSE CAST(quantity * unit_price_excl_vat AS DECIMAL(28,4)) END"
TYPED = """typed AS (SELECT id AS item_id, item_code, CASE WHEN item_code LIKE '%...' THEN 'CHAPTER' WHEN item_code LIKE '%.' THEN CASE WHEN note THEN 'NOTE' ELSE 'SUBCHAPTER' END
  WHEN note OR (unpriced AND item_code <> '') THEN 'NOTE' ELSE 'ITEM' END AS item_type FROM (SELECT *, contains(description, 'בכפוף') OR (unpriced AND length(description) > 15) AS note
  FROM (SELECT *, rate = 0 AND unit = '' AS unpriced FROM items)))"""
LETTER_ITEMS = f"""WITH {V.LEDGER_SQL}, {V.ITEMS_SQL}, {TYPED}, letter_items AS (SELECT l.*, item_code, item_type, CASE item_id % 5 WHEN 0 THEN 'first | {{"page":2}} | third' WHEN 1 THEN 'do it' WHEN 2 THEN 'see plan' WHEN 3 THEN 'plain words' END AS notes
  FROM ledger l JOIN typed USING (item_id)) """
TIES = "line_no, item_id, created_at, total_price_excl_vat, quantity, unit_price_excl_vat"
LETTER_ROWS = f"""{LETTER_ITEMS}, placed AS (SELECT *, row_number() OVER (PARTITION BY letter_id ORDER BY {TIES}) AS place FROM letter_items),
parts AS (SELECT *, 1 AS k FROM placed UNION ALL SELECT *, 2 FROM placed WHERE item_type = 'ITEM' AND ai_rationale <> '' UNION ALL SELECT *, 3 FROM placed WHERE item_type = 'ITEM' AND notes <> '')
SELECT letter_id, CAST(place AS BIGINT) AS place, row_number() OVER (PARTITION BY letter_id, place ORDER BY k) - 1 AS part,
  CASE WHEN k = 1 AND item_type = 'ITEM' THEN '₪' || format('{{:,.2f}}', CAST(CAST(quantity * unit_price_excl_vat AS {M}) AS DOUBLE)) ELSE '' END AS row_total,
  CASE WHEN k = 1 AND item_type = 'ITEM' THEN '₪' || format('{{:,.2f}}', CAST(unit_price_excl_vat AS DOUBLE)) ELSE '' END AS row_price,
  CASE WHEN k = 1 AND item_type = 'ITEM' THEN CAST(quantity AS VARCHAR) ELSE '' END AS row_quantity, CASE WHEN k = 1 AND item_type = 'ITEM' THEN unit ELSE '' END AS row_unit,
  CASE k WHEN 1 THEN CASE WHEN item_type = 'NOTE' THEN 'ⓘ ' ELSE '' END || description WHEN 2 THEN '{X.RATIONALE_PREFIX}' || ai_rationale ELSE '{X.EVIDENCE_PREFIX}' || notes END AS row_text,
  CASE WHEN k > 1 THEN '' WHEN item_type = 'NOTE' THEN '{X.NOTE_TEXT}' ELSE item_code END AS row_code, CASE WHEN k = 1 AND item_type = 'ITEM' THEN CAST(place AS VARCHAR) ELSE '' END AS row_no FROM parts"""
LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EXPORT_LABELS.items())
TOTALS = " UNION ALL ".join(
    f"SELECT project_id, 1, {n}, '{label}', '', '', '', '', '', {v if at == 7 else chr(39) * 2}, '', {v if at == 9 else chr(39) * 2}, {v if at == 10 else chr(39) * 2} FROM sums"
    for n, (label, at, v) in enumerate(zip(["", *X.EXPORT_TOTALS], [0, 7, 7, 7, 9, 10], [f"CAST({c} AS VARCHAR)" for c in "aabcde"], strict=True))
)
EXPORT = f"""WITH {V.LEDGER_SQL}, sums AS (SELECT project_id, {_sum("total_price_excl_vat", "type = 'BASE_CONTRACT'")} AS a, {_sum("total_price_excl_vat", "type <> 'BASE_CONTRACT'")} AS b, {_sum("total_price_excl_vat")} AS c, {_sum("vat_amount")} AS d, {_sum("total_price_incl_vat")} AS e FROM ledger GROUP BY 1),
exported AS (SELECT project_id, 0 AS section, row_number() OVER (PARTITION BY project_id ORDER BY created_at, letter_id, {TIES}) AS place, CASE type {LABELS} ELSE type END AS c1, CASE WHEN item_id % 3 > 0 THEN CAST(item_id AS VARCHAR) ELSE '' END AS c2,
  description || ' "x"' AS c3, unit AS c4, CAST(quantity AS VARCHAR) AS c5, CAST(unit_price_excl_vat AS VARCHAR) AS c6, CAST(total_price_excl_vat AS VARCHAR) AS c7, '0.0000' AS c8, CAST(vat_amount AS VARCHAR) AS c9, CAST(total_price_incl_vat AS VARCHAR) AS c10 FROM ledger
  UNION ALL {TOTALS}) """
HEADERS = f"SELECT letter_id, count(*) AS n_items, {_sum('total_price_excl_vat')} AS total_amount_excl_vat, {_sum('vat_amount')} AS vat_amount, {_sum('total_price_incl_vat')} AS total_amount_incl_vat, 'VO-' || letter_id AS letter_number, 'SENT' AS status"

def ledger_kpis_sql(ledger: str) -> str:
    """KPIs of the table `ledger` that these common table expressions end with."""
    return f"""WITH {ledger}, {V.PROJECTS_SQL}, sums AS (SELECT project_id, {_sum(NET, "type = 'BASE_CONTRACT'")} AS base, {_sum(NET, "type = 'APPROVED_VO'")} AS approved, {_sum(NET, "type IN ('APPROVED_VO', 'SENT_VO')")} AS approved_or_sent,
  {_sum(NET, "type = 'PENDING_VO'")} AS pending, count(*) AS n_rows, count(CASE WHEN ai_rationale <> '' THEN 1 END) AS n_evidence FROM ledger GROUP BY 1),
every AS (SELECT id AS project_id, name, budget, CAST(coalesce(base, 0) AS {M}) AS base, CAST(coalesce(approved, 0) AS {M}) AS approved, CAST(coalesce(approved_or_sent, 0) AS {M}) AS approved_or_sent, CAST(coalesce(pending, 0) AS {M}) AS pending,
  coalesce(n_rows, 0) AS n_rows, coalesce(n_evidence, 0) AS n_evidence FROM projects LEFT JOIN sums ON id = project_id)
SELECT *, CAST(effective_budget + approved_or_sent + pending AS {M}) AS projected, round(CASE WHEN effective_budget <> 0 THEN least(100.0, CAST(approved_or_sent AS DOUBLE) / CAST(effective_budget AS DOUBLE) * 100) ELSE 0.0 END, 6) AS progress_percent
FROM (SELECT *, CASE WHEN budget <> 0 THEN CAST(budget AS {M}) ELSE base END AS effective_budget, CAST(CASE WHEN n_rows > 0 THEN floor(100 * n_evidence / n_rows + 0.5) ELSE 0 END AS BIGINT) AS coverage_percent FROM every)"""


QUERIES = {
    "ledger_generated": (ledger_generated, LEDGER + "SELECT project_id, letter_id, line_no, item_id, total_price_excl_vat, vat_amount, total_price_incl_vat FROM ledger"),
    "ledger_split": (ledger_split, LEDGER + f"""SELECT *, CAST(net * CAST(0.18 AS DECIMAL(5,4)) AS {M}) AS vat_of_subtotal FROM (SELECT project_id, {_sum("total_price_excl_vat", "type = 'BASE_CONTRACT'")} AS base_net, {_sum("total_price_excl_vat", "type <> 'BASE_CONTRACT'")} AS other_net,
  {_sum("total_price_incl_vat", "type = 'BASE_CONTRACT'")} AS base_gross, {_sum("total_price_incl_vat", "type <> 'BASE_CONTRACT'")} AS other_gross, {_sum("total_price_excl_vat")} AS net, {_sum("vat_amount")} AS vat, {_sum("total_price_incl_vat")} AS gross FROM ledger GROUP BY 1)"""),
    "ledger_kpis": (ledger_kpis, ledger_kpis_sql(V.LEDGER_SQL)),
    "vat_repaired": (vat_repaired, LEDGER + f"SELECT project_id, {_sum('vat_amount')} AS vat, {_sum('total_price_incl_vat')} AS gross FROM ledger GROUP BY 1"),
    "line_totals": (line_totals, LETTER_ITEMS + f"""SELECT *, CAST(subtotal + vat AS {M}) AS total FROM (SELECT *, CAST(subtotal * CAST(0.18 AS DECIMAL(5,4)) AS {M}) AS vat FROM (SELECT letter_id, count(CASE WHEN item_type = 'ITEM' THEN 1 END) AS n_items, {_sum("quantity * unit_price_excl_vat", "item_type = 'ITEM'")} AS subtotal FROM letter_items GROUP BY 1))"""),
    "selected_totals": (selected_totals, LEDGER + f"SELECT count(*) AS n_rows, {_sum('total_price_excl_vat')} AS net, {_sum('total_price_incl_vat')} AS gross FROM ledger WHERE item_id % 37 = 0"),
    "estimates": (estimates, f"""WITH {V.ITEMS_SQL} SELECT id, net, vat, CAST(net + vat AS {M}) AS total FROM (SELECT id, net, CAST(net * CAST(0.18 AS DECIMAL(5,4)) AS {M}) AS vat FROM (SELECT id, CAST(CAST(CAST(id % 9 + 1 AS DECIMAL(12,2)) * rate AS DECIMAL(20,4)) * CAST(100 + CASE WHEN id % 4 = 0 THEN 7 ELSE 15 END AS DECIMAL(7,2)) * CAST(0.01 AS DECIMAL(3,2)) AS {M}) AS net FROM items))"""),
    "letter_rows": (letter_rows, LETTER_ROWS),
    "letter_headers": (letter_headers, LEDGER + HEADERS + " FROM ledger WHERE type = 'PENDING_VO' GROUP BY letter_id"),
    "letter_links": (letter_links, LEDGER + f"SELECT letter_id, line_no, item_id, row_number() OVER (PARTITION BY letter_id ORDER BY {TIES}) - 1 AS sort_order FROM ledger WHERE type = 'PENDING_VO'"),
    "ledger_types_after_letters": (ledger_types_after_letters, f"""WITH {V.LEDGER_SQL}, {V.FINDINGS_SQL} SELECT CASE WHEN l.type = 'PENDING_VO' AND f.id IS NOT NULL THEN 'SENT_VO' ELSE l.type END AS type, count(*) AS n, {_sum('total_price_excl_vat')} AS net FROM ledger l LEFT JOIN (SELECT id FROM findings WHERE status = 'OPEN') f ON l.letter_id = f.id GROUP BY 1"""),
    "export_rows": (export_rows, EXPORT + "SELECT * FROM exported"),
    "export_lines": (export_lines, EXPORT + """SELECT project_id, section, place, concat_ws(',', c1, c2, CASE WHEN section = 0 THEN '"' || replace(c3, '"', '""') || '"' ELSE c3 END, c4, c5, c6, c7, c8, c9, c10) AS line FROM exported"""),
}
