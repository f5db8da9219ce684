"""The claims model over the test tables: ledger, findings, items, projects, documents, chat and change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.ledger import with_amounts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order's project and its part's text; three stored amounts."""
    return ledger_stated(ledger_base(spark, sf_dir)).select(
        "project_id", "letter_id", "line_no", "item_id", "type", "source", "description", "unit", "quantity", "unit_price_excl_vat", "vat_rate", "ai_rationale", "created_at", "total_price_excl_vat", "vat_amount", "total_price_incl_vat"
    )


def ledger_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger's other columns follow from."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("o_custkey").alias("project_id"), F.col("l_orderkey").alias("letter_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("flag"), F.col("p_name").alias("description"),
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(15,2)").alias("unit_price_excl_vat"),
        F.when(F.col("l_linestatus") == "F", F.col("p_type")).alias("ai_rationale"), F.col("l_shipdate").alias("created_at"),
    )


def ledger_stated(base: DataFrame) -> DataFrame:
    """Rows of ledger_base with type, source, unit, rate and amounts instead of their flag."""
    flag = F.col("flag")
    kind = F.when(flag == "N", "BASE_CONTRACT").when(flag == "A", "APPROVED_VO").otherwise("PENDING_VO")
    added = {"type": kind, "source": F.when(flag == "N", "BOQ").otherwise("CUSTOM_ANALYSIS"), "unit": F.lit("u"), "vat_rate": F.lit("0.18").cast("decimal(5,4)")}
    return with_amounts(base.withColumns(added).drop("flag"))


LEDGER_SQL = """base_rows AS (SELECT o_custkey AS project_id, l_orderkey AS letter_id, l_linenumber AS line_no, l_partkey AS item_id,
  CASE l_returnflag WHEN 'N' THEN 'BASE_CONTRACT' WHEN 'A' THEN 'APPROVED_VO' ELSE 'PENDING_VO' END AS type,
  CASE WHEN l_returnflag = 'N' THEN 'BOQ' ELSE 'CUSTOM_ANALYSIS' END AS source, p_name AS description, 'u' AS unit,
  CAST(l_quantity AS DECIMAL(12,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(15,2)) AS unit_price_excl_vat, CAST(0.18 AS DECIMAL(5,4)) AS vat_rate,
  CASE WHEN l_linestatus = 'F' THEN p_type END AS ai_rationale, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
ledger AS (SELECT *, CAST(quantity * unit_price_excl_vat AS DECIMAL(15,2)) AS total_price_excl_vat,
  CAST(quantity * unit_price_excl_vat * vat_rate AS DECIMAL(15,2)) AS vat_amount,
  CAST(quantity * unit_price_excl_vat * (1 + vat_rate) AS DECIMAL(15,2)) AS total_price_incl_vat FROM base_rows)"""


def _priority(c: Column) -> Column:
    return F.when(c.isin("1-URGENT", "2-HIGH"), "HIGH").when(c == "3-MEDIUM", "MEDIUM").otherwise("LOW")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    category = F.when(F.col("o_orderpriority") == "1-URGENT", "סתירה").when(F.col("o_orderpriority") == "2-HIGH", "שינוי וגם סתירה").when(F.col("o_orderpriority") == "3-MEDIUM", "שינוי").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "הנחיה")
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "IGNORED").otherwise("MOVED_TO_PRICING")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.concat(F.lit("finding "), F.col("o_orderkey").cast("string"), F.lit(" Powered by a model")).alias("title"), category.alias("category"), _priority(F.col("o_orderpriority")).alias("severity"), status.alias("status"), F.col("o_totalprice").cast("decimal(15,2)").alias("amount"), F.col("o_orderdate").alias("created_at"))


FINDINGS_SQL = """findings AS (SELECT o_orderkey AS id, o_custkey AS project_id, 'finding ' || o_orderkey || ' Powered by a model' AS title,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'סתירה' WHEN '2-HIGH' THEN 'שינוי וגם סתירה' WHEN '3-MEDIUM' THEN 'שינוי' WHEN '4-NOT SPECIFIED' THEN 'הנחיה' END AS category,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'IGNORED' ELSE 'MOVED_TO_PRICING' END AS status,
  CAST(o_totalprice AS DECIMAL(15,2)) AS amount, o_orderdate AS created_at FROM orders)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as price-list rows with coded hierarchy; a few descriptions hold a note word."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ch, sub, plain = two(1 + k % 9), two(1 + k % 7), k % 11 == 0
    code = F.when(k % 50 == 0, F.concat(ch, F.lit("..."))).when(k % 20 == 0, F.concat(ch, F.lit("."), sub, F.lit(".."))).when(k % 15 == 0, F.concat(ch, F.lit("."), sub, F.lit(".01."))).otherwise(F.concat(ch, F.lit("."), sub, F.lit(".01."), F.lpad(k.cast("string"), 7, "0")))
    text = F.concat("p_name", F.lit(" "), "p_type", F.when(k % 37 == 0, " בכפוף").otherwise(""))
    return p.select(k.alias("id"), F.col("p_brand").alias("pricelist_id"), code.alias("item_code"), text.alias("description"), F.when(plain, "").otherwise("u").alias("unit"), F.when(plain, 0).otherwise(F.col("p_retailprice")).cast("decimal(15,2)").alias("rate"))


ITEMS_SQL = """items AS (SELECT p_partkey AS id, p_brand AS pricelist_id,
  CASE WHEN p_partkey % 50 = 0 THEN ch || '...' WHEN p_partkey % 20 = 0 THEN ch || '.' || sub || '..' WHEN p_partkey % 15 = 0 THEN ch || '.' || sub || '.01.'
       ELSE ch || '.' || sub || '.01.' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS item_code,
  p_name || ' ' || p_type || CASE WHEN p_partkey % 37 = 0 THEN ' בכפוף' ELSE '' END AS description, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'u' END AS unit,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(15,2)) AS rate
  FROM (SELECT *, lpad(CAST(1 + p_partkey % 9 AS VARCHAR), 2, '0') AS ch, lpad(CAST(1 + p_partkey % 7 AS VARCHAR), 2, '0') AS sub FROM part))"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer; every 17th budget is zero."""
    c = table(spark, sf_dir, "customer")
    budget = F.when(F.col("c_custkey") % 17 == 0, 0).otherwise(F.col("c_acctbal")).cast("decimal(15,2)")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("contractor_id"), budget.alias("budget"))


PROJECTS_SQL = """projects AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS contractor_id,
  CAST(CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE c_acctbal END AS DECIMAL(15,2)) AS budget FROM customer)"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price lists of the items: one a brand, of the project with its number; every other one is global."""
    n = F.substring("id", 7, 9).cast("bigint")
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct()
    return own.select("id", F.concat(F.lit("list "), "id").alias("name"), (n % 2 == 0).alias("is_global"), n.alias("project_id"))


LISTS_SQL = "lists AS (SELECT id, 'list ' || id AS name, n % 2 = 0 AS is_global, n AS project_id FROM (SELECT DISTINCT p_brand AS id, CAST(substr(p_brand, 7) AS BIGINT) AS n FROM part))"


def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of projects (sources), with a title and a category."""
    d = table(spark, sf_dir, "documents")
    words = F.array(*[F.lit(x) for x in ("BOQ", "הסכם", "מפרט", "פרוטוקול", "מחירון דקל", "plan.PDF", "photo.jpg")])
    title = F.concat(F.get(words, (F.col("doc_id") % 7).cast("int")), F.lit(" "), F.col("doc_id").cast("string"))
    category = F.when(F.col("lang") == "en", "CONTRACT").when(F.col("lang") == "fr", "PRICELIST").otherwise("EXECUTION")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"), title.alias("title"), category.alias("category"), F.col("text").alias("extracted_text"), F.when(F.col("doc_id") % 5 == 0, "VALIDATED").otherwise("PENDING").alias("ai_status"))


DOCUMENTS_SQL = """docs AS (SELECT doc_id AS id, source AS project_id, list_extract(['BOQ','הסכם','מפרט','פרוטוקול','מחירון דקל','plan.PDF','photo.jpg'], CAST(doc_id % 7 + 1 AS INT)) || ' ' || doc_id AS title,
  CASE lang WHEN 'en' THEN 'CONTRACT' WHEN 'fr' THEN 'PRICELIST' ELSE 'EXECUTION' END AS category, text AS extracted_text,
  CASE WHEN doc_id % 5 = 0 THEN 'VALIDATED' ELSE 'PENDING' END AS ai_status FROM documents)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change feed of findings keyed by user: op, seq, id, severity, status."""
    return change_rows(table(spark, sf_dir, "events"))


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed as a stream of the file."""
    return change_rows(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*"))


def change_rows(events: DataFrame) -> DataFrame:
    e, v = events, F.col("event_type")
    op = F.when(v == "signup", "INSERT").when(v == "error", "DELETE").otherwise("UPDATE")
    return e.select(op.alias("op"), F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("value") > 20, "HIGH").otherwise("LOW").alias("severity"), F.when(v == "purchase", "IGNORED").otherwise("OPEN").alias("status"))


CHANGES_SQL = """changes AS (SELECT CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, event_id AS seq, user_id AS id,
  CASE WHEN value > 20 THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN event_type = 'purchase' THEN 'IGNORED' ELSE 'OPEN' END AS status FROM events)"""
