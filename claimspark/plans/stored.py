"""Queries over what is stored and changed: loads that keep what they refuse, rewritten partitions, deletes over the graph of references, workbooks, sums kept up to date."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimspark.functions import fixed as X
from claimspark.operators import ledger as L
from claimspark.operators.changes import one_row
from claimspark.operators.constraints import Constraints
from claimspark.operators.references import Reference, deleted
from claimspark.sources import files, stored, views as V, workbooks
from claimspark.sources.shared import kept, scratch
from claimspark.streaming import sinks

from .money import ledger_kpis_sql


def rows_quarantined(spark, sf):
    """Ledger rows in two loads, of which the second is run twice: rows without evidence, of pending orders, of projects that are gone, or of an item that the project has, are refused."""
    rows = kept(V.ledger(spark, sf).select("letter_id", "line_no", "project_id", "item_id", "type", "ai_rationale"))  # each load reads them twice
    there = V.projects(spark, sf).filter("id % 10 <> 0").select("id")
    rules = Constraints(not_null=("ai_rationale",), members={"type": ("BASE_CONTRACT", "APPROVED_VO")}, references={"project_id": (there, "id")}, unique=(("project_id", "item_id"),))
    path = scratch(spark)
    for load, half in (("a", "letter_id % 2 = 0"), ("b", "letter_id % 2 = 1"), ("b", "letter_id % 2 = 1")):
        stored.load(rows.filter(half), path, load, rules, ["letter_id", "line_no"])
    taken, refused = stored.loaded(spark, path), stored.refused(spark, path)
    own = ["load", "letter_id", "line_no", "project_id", "item_id"]
    return taken.select(*own, F.lit("").alias("reasons")).unionByName(refused.select(*own, F.array_join("reasons", ",").alias("reasons")))


BROKEN = """concat_ws(',', CASE WHEN ai_rationale IS NULL THEN 'null:ai_rationale' END, CASE WHEN type NOT IN ('BASE_CONTRACT', 'APPROVED_VO') THEN 'member:type' END,
  CASE WHEN project_id NOT IN (SELECT id FROM projects WHERE id % 10 <> 0) THEN 'reference:project_id' END)"""
QUARANTINED = f"""WITH {V.LEDGER_SQL}, {V.PROJECTS_SQL},
checked AS (SELECT CASE WHEN letter_id % 2 = 0 THEN 'a' ELSE 'b' END AS load, letter_id, line_no, project_id, item_id, {BROKEN} AS reasons FROM ledger),
placed AS (SELECT *, min(load) FILTER (reasons = '') OVER (PARTITION BY project_id, item_id) AS first_load, row_number() OVER (PARTITION BY project_id, item_id, load, reasons = '' ORDER BY letter_id, line_no) AS n FROM checked)
SELECT load, letter_id, line_no, project_id, item_id, CASE WHEN reasons = '' AND (n > 1 OR load > first_load) THEN 'unique:project_id+item_id' ELSE reasons END AS reasons FROM placed"""


def stored_ledger_changed(spark, sf):
    """A stored ledger, by buckets of letters, of which a few are rewritten: urgent letters get the old VAT rate, others go, and rows of some items are renamed by LIKE."""
    path, bucket = scratch(spark), F.pmod("letter_id", F.lit(16)).cast("int")
    V.ledger(spark, sf).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("letter_id"), "o_orderpriority")
    urgent = o.filter("o_orderpriority = '1-URGENT' and letter_id % 16 in (1, 2)").select("letter_id", F.lit(X.OLD_VAT_RATE).cast("decimal(5,4)").alias("new_rate"))
    net = F.col("quantity") * F.col("unit_price_excl_vat")
    values = {"vat_rate": F.col("new_rate"), "vat_amount": (net * F.col("new_rate")).cast("decimal(15,2)"), "total_price_incl_vat": (net * (1 + F.col("new_rate"))).cast("decimal(15,2)")}
    stored.update_stored(spark, path, ["bucket"], urgent, "letter_id", values)
    stored.delete_stored(spark, path, ["bucket"], o.filter("letter_id % 32 = 5").select("letter_id"), "letter_id")
    stored.update_stored_where(spark, path, ["bucket"], F.col("description").like("%widget%") & (F.col("bucket") == 3), {"description": F.lit("renamed")})
    stored.delete_stored_where(spark, path, ["bucket"], F.col("bucket") == 7)
    done = spark.read.parquet(path)
    return done.groupBy("bucket", "project_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("description") == "renamed").alias("n_renamed"), L.money_sum("total_price_excl_vat").alias("net"), L.money_sum("vat_amount").alias("vat"), L.money_sum("total_price_incl_vat").alias("gross"))


STORED = f"""WITH {V.LEDGER_SQL},
changed AS (SELECT l.*, CAST(letter_id % 16 AS INTEGER) AS bucket, CASE WHEN o_orderpriority = '1-URGENT' AND letter_id % 16 IN (1, 2) THEN CAST({X.OLD_VAT_RATE} AS DECIMAL(5,4)) ELSE vat_rate END AS rate FROM ledger l JOIN orders ON o_orderkey = letter_id WHERE letter_id % 32 <> 5 AND letter_id % 16 <> 7)
SELECT bucket, project_id, count(*) AS n_rows, count(*) FILTER (bucket = 3 AND description LIKE '%widget%') AS n_renamed, CAST(sum(total_price_excl_vat) AS DECIMAL(18,2)) AS net, CAST(sum(CAST(quantity * unit_price_excl_vat * rate AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS vat,
  CAST(sum(CAST(quantity * unit_price_excl_vat * (1 + rate) AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS gross FROM changed GROUP BY 1, 2"""

#: Four levels of references that cascade, one that becomes null.
REFERENCES = [Reference("projects", "contractor_id", "contractors"), Reference("findings", "project_id", "projects"), Reference("ledger", "letter_id", "findings"), Reference("ledger", "item_id", "items", cascade=False)]


def cascade_over_references(spark, sf):
    """Contractors and items go: projects, findings and ledger rows go with the contractors, the items' ledger rows lose their item."""
    line = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("letter_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_id"))
    tables = {"contractors": V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), "projects": V.projects(spark, sf).select("id", "contractor_id"), "findings": V.findings(spark, sf).select("id", "project_id"), "items": V.items(spark, sf).select("id"), "ledger": line}
    doomed = {"contractors": tables["contractors"].filter("id % 5 = 2"), "items": tables["items"].filter("id % 7 = 3")}
    after = deleted(tables, REFERENCES, doomed, kept)
    shown = lambda name, parent, of: after[name].groupBy(F.col(parent).cast("bigint").alias("parent")).agg(F.count("*").alias("n_rows"), F.count(of).alias("n_referring")).select(F.lit(name).alias("tbl"), "parent", "n_rows", "n_referring")
    return shown("contractors", "id", "id").unionByName(shown("projects", "contractor_id", "id")).unionByName(shown("findings", "project_id", "id")).unionByName(shown("items", "id", "id")).unionByName(shown("ledger", "letter_id", "item_id"))


def stored_cascade(spark, sf):
    """The same deletes on stored tables: only partitions that hold something that goes, or refers to it, are rewritten."""
    top = scratch(spark)
    sixteenth = lambda c: F.pmod(F.col(c), F.lit(16)).cast("int").alias("part")
    tables = {
        "contractors": V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lit(0).alias("part")), "projects": V.projects(spark, sf).select("id", "contractor_id", sixteenth("contractor_id")),
        "findings": V.findings(spark, sf).select("id", "project_id", sixteenth("project_id")), "items": V.items(spark, sf).select("id", sixteenth("id")),
        "ledger": V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("letter_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_id"), sixteenth("l_partkey")),
    }
    for name, rows in tables.items():
        rows.write.partitionBy("part").parquet(f"{top}/{name}")
    held = {name: stored.StoredTable(f"{top}/{name}", ["part"]) for name in tables}
    doomed = {"contractors": tables["contractors"].filter("id % 5 = 2").select("id"), "items": tables["items"].filter("id % 112 = 3").select("id")}
    stored.delete_cascade(spark, held, REFERENCES, doomed)
    after = {name: spark.read.parquet(t.path) for name, t in held.items()}
    shown = lambda name, of: after[name].groupBy("part").agg(F.count("*").alias("n_rows"), F.count(of).alias("n_referring")).select(F.lit(name).alias("tbl"), F.col("part").cast("int").alias("part"), "n_rows", "n_referring")
    return shown("contractors", "id").unionByName(shown("projects", "contractor_id")).unionByName(shown("findings", "project_id")).unionByName(shown("items", "id")).unionByName(shown("ledger", "item_id"))


STORED_CASCADE = """WITH p AS (SELECT c_custkey AS id, c_nationkey AS contractor FROM customer WHERE c_nationkey % 5 <> 2), f AS (SELECT o_orderkey AS id, o_custkey AS project FROM orders WHERE o_custkey IN (SELECT id FROM p))
SELECT 'contractors' AS tbl, 0 AS part, count(*) AS n_rows, count(*) AS n_referring FROM nation WHERE n_nationkey % 5 <> 2 HAVING count(*) > 0
UNION ALL SELECT 'projects', CAST(contractor % 16 AS INTEGER), count(*), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'findings', CAST(project % 16 AS INTEGER), count(*), count(*) FROM f GROUP BY 2
UNION ALL SELECT 'items', CAST(p_partkey % 16 AS INTEGER), count(*), count(*) FROM part WHERE p_partkey % 112 <> 3 GROUP BY 2
UNION ALL SELECT 'ledger', CAST(l_partkey % 16 AS INTEGER), count(*), count(*) FILTER (l_partkey % 112 <> 3) FROM lineitem WHERE l_orderkey IN (SELECT id FROM f) GROUP BY 2"""

CASCADE = """WITH p AS (SELECT c_custkey AS id, c_nationkey AS contractor FROM customer WHERE c_nationkey % 5 <> 2), f AS (SELECT o_orderkey AS id, o_custkey AS project FROM orders WHERE o_custkey IN (SELECT id FROM p))
SELECT 'contractors' AS tbl, CAST(n_nationkey AS BIGINT) AS parent, count(*) AS n_rows, count(*) AS n_referring FROM nation WHERE n_nationkey % 5 <> 2 GROUP BY 2
UNION ALL SELECT 'projects', CAST(contractor AS BIGINT), count(*), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'findings', CAST(project AS BIGINT), count(*), count(*) FROM f GROUP BY 2
UNION ALL SELECT 'items', CAST(p_partkey AS BIGINT), count(*), count(*) FROM part WHERE p_partkey % 7 <> 3 GROUP BY 2
UNION ALL SELECT 'ledger', CAST(l_orderkey AS BIGINT), count(*), count(*) FILTER (l_partkey % 7 <> 3) FROM lineitem WHERE l_orderkey IN (SELECT id FROM f) GROUP BY 2"""


def _books(spark, sf):
    """Price lists as workbooks with a sheet a chapter, written by Spark."""
    path = scratch(spark)
    own = V.items(spark, sf).withColumn("file", F.concat("pricelist_id", F.lit(".xlsx"))).withColumn("chapter", F.concat(F.lit("ch "), F.substring("item_code", 1, 2)))
    workbooks.write(own, path, "file", "chapter", ["item_code", "description", "unit", "rate"], ["item_code", "id"])
    return path


def workbook_rows(spark, sf):
    """Rows of all sheets but their headers; of the columns only two are read."""
    rows = workbooks.read(spark, _books(spark, sf), columns="A,D").filter("row_no > 0")
    return rows.select("file", "sheet", "position", "row_no", F.get("cells", F.lit(0)).alias("item_code"), F.get("cells", F.lit(1)).alias("rate"))


def workbook_first_sheets(spark, sf):
    rows = workbooks.read(spark, _books(spark, sf), sheets="first").filter("row_no > 0")
    return rows.groupBy("file", "sheet").agg(F.count("*").alias("n_rows"), F.max(F.get("cells", F.lit(1))).alias("last_description"))


def workbook_census(spark, sf):
    return workbooks.census(spark, _books(spark, sf))


def workbook_heads(spark, sf):
    """The first five rows of the workbooks' first sheets, headers left out."""
    head = files.sheet_head(files.read_workbooks(spark, _books(spark, sf)), 5)
    return head.select("file", "row_no", F.col("service_type").alias("first_cell"), F.col("item_code").alias("second_cell"))


def workbooks_asked(spark, sf):
    """The workbooks as files of a kind (with the MIME type that files have without a header), and what a function of type and base64 content says of each."""
    found = files.read_documents(spark, _books(spark, sf))
    return files.with_model(found, lambda mime, content: f"{mime} {content[:4]}").select("name", "kind", "mime", "response")


def rows_appended(spark, sf):
    """Items in batches of a price list each but for one, which comes row by row; a batch that fails writes nothing."""
    path, rows = scratch(spark), V.items(spark, sf).select("id", "item_code", "pricelist_id", "rate")
    files.append(rows.filter("pricelist_id <> 'Brand#1'"), path, ["pricelist_id"])
    files.append(rows.filter("pricelist_id = 'Brand#1'"), path, ["pricelist_id"])
    try:
        files.append(rows.withColumn("rate", F.raise_error(F.lit("a batch that fails")).cast("decimal(15,2)")), path, ["pricelist_id"])
    except PySparkException:  # the error is the caller's to handle; the table is as it was
        pass
    return spark.read.parquet(path).groupBy("pricelist_id").agg(F.count("*").alias("n_rows"), F.min("item_code").alias("first_code"), F.sum("rate").cast("decimal(18,2)").alias("rates"))


def heads_dumped(spark, sf):
    """The first rows as JSON lines, read again."""
    path = scratch(spark)
    files.write_head(V.items(spark, sf).select("item_code", "id", "description"), path, 7, ["item_code", "id"])
    return spark.read.schema("item_code string, id bigint, description string").json(path)


def only_project(spark, sf):
    """The one project that has a key; none or several would be an error."""
    row = one_row(V.projects(spark, sf).filter("id = 5"))
    return spark.createDataFrame([row], V.projects(spark, sf).schema)


BOOKS = f"WITH {V.ITEMS_SQL}, books AS (SELECT *, pricelist_id || '.xlsx' AS file, 'ch ' || substr(item_code, 1, 2) AS sheet FROM items), placed AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY file ORDER BY sheet) - 1 AS INTEGER) AS position, row_number() OVER (PARTITION BY file, sheet ORDER BY item_code, id) AS row_no FROM books) "


def _change_rows(spark, sf):
    """Changes of the ledger in three parts: all rows come; every fifth letter's pending rows are approved; every seventh letter goes, every eleventh gets the old VAT rate and its amounts."""
    rows = V.ledger(spark, sf)
    names = rows.columns
    row = lambda df: F.struct(*[df[c] for c in names])
    approved = lambda t: F.when((F.col("letter_id") % 5 == 0) & (t == "PENDING_VO"), "APPROVED_VO").otherwise(t)
    first = rows.select(F.lit(None).cast(rows.schema).alias("old"), row(rows).alias("new"))
    second = rows.filter((F.col("letter_id") % 5 == 0) & (F.col("type") == "PENDING_VO"))
    second = second.select(row(second).alias("old"), F.struct(*[approved(F.col(c)).alias(c) if c == "type" else F.col(c) for c in names]).alias("new"))
    now = rows.withColumn("type", approved(F.col("type")))
    third = now.filter("letter_id % 7 = 0").select(F.struct(*names).alias("old"), F.lit(None).cast(rows.schema).alias("new"))
    dearer = now.filter("letter_id % 7 <> 0 and letter_id % 11 = 0")
    priced = L.with_amounts(dearer.withColumn("_was", F.struct(*names)).withColumn("quantity", (F.col("quantity") + 1).cast("decimal(12,2)")))
    fourth = priced.select(F.col("_was").alias("old"), F.struct(*names).alias("new"))
    return [first, second, third.unionByName(fourth)]


def stream_ledger_kpis(spark, sf):
    """KPIs of what the changes of a ledger added up to, batch by batch; the ledger itself is not read for them."""
    path = scratch(spark)
    parts = _change_rows(spark, sf)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/changes")
    changes = spark.readStream.schema(parts[0].schema).parquet(f"{path}/changes")
    sinks.ledger_deltas(changes, f"{path}/kpis").awaitTermination()
    return sinks.streamed_kpis(spark, f"{path}/kpis", V.projects(spark, sf))


AFTER = f"""{V.LEDGER_SQL.replace("ledger AS", "stated AS")}, changed AS (SELECT * REPLACE (CASE WHEN letter_id % 5 = 0 AND type = 'PENDING_VO' THEN 'APPROVED_VO' ELSE type END AS type, CAST(CASE WHEN letter_id % 11 = 0 THEN quantity + 1 ELSE quantity END AS DECIMAL(12,2)) AS quantity) FROM stated WHERE letter_id % 7 <> 0),
ledger AS (SELECT * REPLACE (CAST(quantity * unit_price_excl_vat AS DECIMAL(15,2)) AS total_price_excl_vat) FROM changed)"""

QUERIES = {
    "rows_quarantined": (rows_quarantined, QUARANTINED),
    "stored_ledger_changed": (stored_ledger_changed, STORED),
    "cascade_over_references": (cascade_over_references, CASCADE),
    "stored_cascade": (stored_cascade, STORED_CASCADE),
    "workbook_rows": (workbook_rows, BOOKS + "SELECT file, sheet, position, row_no, item_code, CAST(rate AS VARCHAR) AS rate FROM placed"),
    "workbook_first_sheets": (workbook_first_sheets, BOOKS + "SELECT file, sheet, count(*) AS n_rows, max(description) AS last_description FROM placed WHERE position = 0 GROUP BY 1, 2"),
    "workbook_census": (workbook_census, BOOKS + "SELECT file, sheet, position, 'visible' AS state, 'A1:D' || (count(*) + 1) AS cell_range, count(*) + 1 AS n_rows FROM placed GROUP BY 1, 2, 3"),
    "workbook_heads": (workbook_heads, BOOKS + "SELECT file, row_no, item_code AS first_cell, description AS second_cell FROM placed WHERE position = 0 ORDER BY file, row_no LIMIT 5"),
    "workbooks_asked": (workbooks_asked, BOOKS + "SELECT DISTINCT file AS name, 'sheet' AS kind, 'application/pdf' AS mime, 'application/pdf UEsD' AS response FROM placed"),
    "rows_appended": (rows_appended, f"WITH {V.ITEMS_SQL} SELECT pricelist_id, count(*) AS n_rows, min(item_code) AS first_code, CAST(sum(rate) AS DECIMAL(18,2)) AS rates FROM items GROUP BY 1"),
    "heads_dumped": (heads_dumped, f"WITH {V.ITEMS_SQL} SELECT item_code, id, description FROM items ORDER BY item_code, id LIMIT 7"),
    "only_project": (only_project, f"WITH {V.PROJECTS_SQL} SELECT id, name, contractor_id, budget FROM projects WHERE id = 5"),
    "stream_ledger_kpis": (stream_ledger_kpis, ledger_kpis_sql(AFTER)),
}
