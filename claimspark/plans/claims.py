"""Queries of findings, documents, visibility, chat, changes and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import fixed as X, scalars as S
from claimspark.operators import changes, documents as D, findings as Fi, letters, search, security
from claimspark.sources import views as V
from claimspark.sources.shared import AS_DIFFERENCES, beside

FINDINGS = f"WITH {V.FINDINGS_SQL} "
DOCS = f"WITH {V.DOCUMENTS_SQL} "
RANK = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"
SHOWN = f"CASE WHEN coalesce(contains(category, 'סתירה'), false) OR severity = 'HIGH' THEN '{X.CONTRADICTION_LABEL}' WHEN coalesce(contains(category, 'שינוי') OR contains(category, 'הנחיה'), false) OR severity = 'MEDIUM' THEN '{X.CHANGE_LABEL}' ELSE '{X.SITE_EVENT_LABEL}' END"


def finding_classes(spark, sf):
    c = F.col("category")
    return V.findings(spark, sf).select("id", Fi.severity(c).alias("severity_by_text"), Fi.shown_as(c, F.col("severity")).alias("shown_as"), Fi.critical(c, F.col("severity")).alias("critical"), Fi.clean(F.col("title")).alias("clean_title"))


def findings_parsed(spark, sf):
    """Each finding as a text model's answer, with words around the JSON."""
    item = F.to_json(F.array(F.struct("title", F.lit("what Powered by x. stays").alias("description"), "category", F.struct(F.lit("high").alias("risk_assessment")).alias("expert_strategy"))))
    rows = Fi.parsed(V.findings(spark, sf).select("id", F.concat(F.lit("```json\n"), item, F.lit("\n``` done")).alias("response")))
    return rows.select("id", "part", "title", "description", "category", "severity", F.get_json_object("evidence_data", "$.expert_strategy.risk_assessment").alias("risk"))


def severity_feed(spark, sf):
    f = V.findings(spark, sf)
    return f.orderBy(*Fi.by_severity(f)).limit(5).select("id", "severity", "created_at")


def queue_grouped(spark, sf):
    """Findings of two statuses by their source document's title; documents are projects' names here, some missing."""
    named = V.projects(spark, sf).select("id", "name")
    side = lambda a: named.select(F.col("id").alias(f"{a}_id"), F.col("name").alias(f"{a}_title"))
    f = Fi.queue(V.findings(spark, sf), ["OPEN", "MOVED_TO_PRICING"]).withColumn("source_id", F.when(F.col("id") % 10 > 0, F.col("project_id"))).withColumn("target_id", F.col("project_id") + 1)
    both = f.join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    return Fi.grouped_queue(both, "source_title", "other")


def status_counts(spark, sf):
    return Fi.status_counts(V.findings(spark, sf), "project_id")


def insights(spark, sf):
    return Fi.insights(V.findings(spark, sf), V.ledger(spark, sf))


def project_context(spark, sf):
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.coalesce("category", F.lit("?")))
    return Fi.context(V.findings(spark, sf), "project_id", line, ["created_at", "id"], 10)


def _scanned(spark, sf, **how):
    """What a scan of project 7 leaves of each project's findings, by document."""
    f = V.findings(spark, sf).withColumn("source_execution_doc_id", F.when(F.col("id") % 4 > 0, F.col("id") % 3))
    kept, scan = Fi.scan_control(f, 7, **how)
    return kept.groupBy("project_id", "source_execution_doc_id").agg(F.count("*").alias("n")).withColumn("scan", F.lit(scan))


def scan_cached(spark, sf):
    return _scanned(spark, sf)


def scan_forced(spark, sf):
    """Also with a document all of the project goes."""
    return _scanned(spark, sf, force=True, work_document=1)


def scan_one_document(spark, sf):
    return _scanned(spark, sf, work_document=1)


def moved_to_pricing(spark, sf):
    """Open severe findings as ledger rows."""
    return Fi.as_ledger_row(V.findings(spark, sf).filter("status = 'OPEN' and severity = 'HIGH'").withColumn("description", F.lit("")))


def strategy_merged(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", Fi.merge_strategy(F.col("props"), F.when(F.col("event_id") % 2 == 0, '{"a":1}')).alias("m"))
    return e.select("event_id", F.get_json_object("m", "$.k").cast("bigint").alias("k"), F.get_json_object("m", "$.expert_strategy.a").cast("bigint").alias("a"))


def document_classes(spark, sf):
    t, none = F.col("title"), F.lit(None).cast("string")
    c = D.class_by_title(t, F.col("category"))
    return V.project_documents(spark, sf).select("id", c["type"].alias("type"), c["category"].alias("category"), D.mime_type(t, none).alias("mime"), D.file_kind(F.split(t, " ")[0], none).alias("kind"), D.synced_status(F.col("extracted_text"), F.col("ai_status")).alias("status"))


def document_states(spark, sf):
    outcomes = F.array(*[F.lit(x) for x in ("started", "parsed", "by_title", "failed", "waiting")])
    d = D.extraction(V.project_documents(spark, sf)).withColumn("next", D.next_status(F.col("ai_status"), F.get(outcomes, (F.col("id") % 5).cast("int"))))
    return d.groupBy("extraction", "next").agg(F.count("*").alias("n"))


def document_content(spark, sf):
    """Parsed content made from the documents' own fields."""
    k = F.col("id")
    items = F.when(k % 2 == 0, F.array(F.struct(k.cast("string").alias("code"), F.lit(1.5).alias("quantity"))))
    json = F.when(k % 9 == 0, "not json").otherwise(F.to_json(F.struct(F.struct(items.alias("items")).alias("financial_data"), F.when(k % 3 == 0, F.array(F.lit("w1"), F.lit("w2"))).alias("warnings"), F.lit("md").alias("full_markdown"))))
    d = D.content(V.project_documents(spark, sf).withColumn("parsed_json", json))
    return d.select("id", "is_document", "has_items", "has_warnings", F.coalesce(F.get("content.financial_data.items", F.lit(0))["code"], F.lit("")).alias("first_code"), F.when(F.col("has_warnings"), F.size("content.warnings")).otherwise(0).cast("bigint").alias("n_warnings"))


def contracts_by_executions(spark, sf):
    """The result is quadratic, so whoever writes it as Parquet gets its ids and steps, which are in order, as differences."""
    return D.pairs_in_project(V.project_documents(beside(spark, AS_DIFFERENCES), sf))


def first_documents(spark, sf):
    return search.first_per_group(V.project_documents(spark, sf), ["project_id", "category"], ["id"]).select("project_id", "category", "id", "title")


def visible_findings(spark, sf):
    return security.visible(V.findings(spark, sf), V.projects(spark, sf), 7).select("id", "project_id")


def chat_history(spark, sf):
    return letters.history(V.table(spark, sf, "conversations"), "conv_id", "turn")


def feed_state(spark, sf):
    return changes.latest_state(V.changes(spark, sf))


def feed_open_high(spark, sf):
    return changes.latest_state(V.changes(spark, sf)).agg(F.count_if((F.col("status") == "OPEN") & (F.col("severity") == "HIGH")).alias("n"))


def cascade_deletes(spark, sf):
    """Projects with a negative budget go: their findings go too, ledger references become null."""
    gone = V.projects(spark, sf).filter("budget < 0").select("id")
    f = changes.cascade(V.findings(spark, sf), "project_id", gone).groupBy().agg(F.count("*").alias("findings_left"))
    d = changes.set_null(V.ledger(spark, sf).select("project_id", "item_id"), "project_id", gone).agg(F.count("*").alias("rows_left"), F.count("project_id").alias("references_left"))
    return f.join(d)


def profiles_inserted(spark, sf):
    have = V.projects(spark, sf).select("id", "name").filter("id < 1000")
    new = V.findings(spark, sf).select(F.col("project_id").alias("id"), F.concat(F.lit("new "), F.col("project_id").cast("string")).alias("name"))
    return changes.insert_missing(have, new, "id")


def text_markers(spark, sf):
    text = F.concat(F.lit("see [1] and "), F.substring("p_name", 1, 4), F.lit("[2][3] end[1]"))
    return V.table(spark, sf, "part").select("p_partkey", F.posexplode(letters.marked_parts(text)).alias("part_no", "part")).withColumn("part_no", F.col("part_no").cast("bigint"))


def evidence_and_notes(spark, sf):
    k = F.col("p_partkey")
    evidence = F.when(k % 3 == 0, '[{"document_title":"plan","page":3},{"page":null}]').when(k % 3 == 1, '{"clause":"4"}')
    note = F.concat(F.lit('{"MARKET_ANALYSIS":"m'), k.cast("string"), F.lit('","other":"o"}'))
    return V.table(spark, sf, "part").select("p_partkey", letters.evidence_lines(evidence).alias("evidence"), F.array_join(letters.note_lines(note), "; ").alias("notes"))


def scalar_formats(spark, sf):
    o, n = V.table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", S.pad2(n % 150).alias("padded"), S.round_half_up((n % 40 - 20) / 4).cast("bigint").alias("rounded"), F.date_format("o_orderdate", "d.M.yyyy").alias("day"), F.right(F.lpad(n.cast("string"), 9, "0"), F.lit(6)).alias("tail"), S.string_bucket(F.concat(F.lit("project-"), n.cast("string"), F.lit("-é")), 7).cast("bigint").alias("bucket"), S.dash(F.when(n % 2 == 0, "").otherwise("x")).alias("dashed"), S.parse_float(F.concat(n.cast("string"), F.lit("e1x"))).alias("parsed"), S.shekels(F.col("o_totalprice").cast("decimal(15,2)")).alias("shekels"))


def json_fields(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("event_id", S.text_or(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k"), F.lit("none")).alias("value"))


SCANNED = "SELECT project_id, CASE WHEN id % 4 > 0 THEN id % 3 END AS source_execution_doc_id, count(*) AS n, "
SCANNED_FROM = " AS scan FROM findings WHERE "

DOC_CLASS = " ".join("WHEN " + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + f" THEN '{{0}}{kind}{{1}}{of}'" for words, kind, of in X.TITLE_CLASSES).replace("{0}", "").replace("{1}", "|")

QUERIES = {
    "finding_classes": (finding_classes, FINDINGS + f"SELECT id, CASE WHEN contains(category, 'סתירה') THEN 'HIGH' WHEN contains(category, 'שינוי') THEN 'MEDIUM' ELSE 'LOW' END AS severity_by_text, {SHOWN} AS shown_as, coalesce(contains(category, 'סתירה'), false) OR severity = 'HIGH' AS critical, 'finding ' || id AS clean_title FROM findings"),
    "findings_parsed": (findings_parsed, FINDINGS + "SELECT id, 0 AS part, 'finding ' || id AS title, 'what. stays' AS description, category, CASE WHEN contains(category, 'סתירה') THEN 'HIGH' WHEN contains(category, 'שינוי') THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'high' AS risk FROM findings"),
    "severity_feed": (severity_feed, FINDINGS + f"SELECT id, severity, created_at FROM findings ORDER BY {RANK} DESC, created_at DESC, id LIMIT 5"),
    "queue_grouped": (queue_grouped, f"WITH {V.FINDINGS_SQL}, {V.PROJECTS_SQL} SELECT coalesce(name, 'other') AS group_title, count(*) AS n_findings, min(created_at) AS first_seen, arg_min(f.id, (created_at, f.id)) AS first_id FROM findings f LEFT JOIN projects p ON p.id = CASE WHEN f.id % 10 > 0 THEN f.project_id END WHERE status IN ('OPEN', 'MOVED_TO_PRICING') GROUP BY 1"),
    "status_counts": (status_counts, FINDINGS + "SELECT project_id, count(*) AS n, count(*) FILTER (status = 'OPEN') AS n_open, count(*) FILTER (status = 'OPEN' AND severity = 'HIGH') AS n_open_high, count(*) FILTER (coalesce(contains(category, 'סתירה'), false) OR severity = 'HIGH') AS n_critical, count(*) FILTER (category <> '') AS n_categorised FROM findings GROUP BY 1"),
    "insights": (insights, f"""WITH {V.FINDINGS_SQL}, {V.LEDGER_SQL} SELECT CAST(id AS VARCHAR) AS ref, 'contradiction' AS type, severity, title, CAST(NULL AS DECIMAL(15,2)) AS amount FROM (SELECT * FROM findings WHERE status = 'OPEN' ORDER BY {RANK} DESC, created_at DESC, id LIMIT 5)
UNION ALL SELECT letter_id || '/' || line_no || '/' || item_id, 'risk', 'MEDIUM', '{X.PENDING_VO_PREFIX}' || description, total_price_excl_vat FROM (SELECT * FROM ledger WHERE type = 'PENDING_VO' ORDER BY letter_id, line_no, item_id LIMIT 3)"""),
    "project_context": (project_context, FINDINGS + "SELECT project_id, string_agg('- ' || title || ': ' || coalesce(category, '?'), chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS n FROM findings) WHERE n <= 10 GROUP BY 1"),
    "scan_cached": (scan_cached, FINDINGS + SCANNED + "NOT EXISTS (SELECT 1 FROM findings WHERE project_id = 7)" + SCANNED_FROM + "true GROUP BY 1, 2"),
    "scan_forced": (scan_forced, FINDINGS + SCANNED + "true" + SCANNED_FROM + "project_id <> 7 GROUP BY 1, 2"),
    "scan_one_document": (scan_one_document, FINDINGS + SCANNED + "true" + SCANNED_FROM + "NOT (project_id = 7 AND id % 4 > 0 AND id % 3 = 1) GROUP BY 1, 2"),
    "moved_to_pricing": (moved_to_pricing, FINDINGS + "SELECT project_id, 'PENDING_VO' AS type, 'CUSTOM_ANALYSIS' AS source, title AS description, CAST(1 AS DECIMAL(12,2)) AS quantity, CAST(0 AS DECIMAL(15,2)) AS unit_price_excl_vat, id AS contradiction_id FROM findings WHERE status = 'OPEN' AND severity = 'HIGH'"),
    "strategy_merged": (strategy_merged, "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(CASE WHEN event_id % 2 = 0 THEN 1 END AS BIGINT) AS a FROM events"),
    "document_classes": (document_classes, DOCS + f"""SELECT id, string_split(c, '|')[1] AS type, string_split(c, '|')[2] AS category, CASE WHEN lower(title) LIKE '%.png' THEN 'image/png' ELSE 'application/pdf' END AS mime, CASE WHEN id % 7 = 5 THEN 'pdf' END AS kind, CASE WHEN length(extracted_text) > 50 AND ai_status <> 'VALIDATED' THEN 'DONE' ELSE ai_status END AS status
FROM (SELECT *, CASE {DOC_CLASS} WHEN category = 'CONTRACT' THEN 'מסמך חוזי|CONTRACT' WHEN category = 'PRICELIST' THEN 'מחירון|PRICELIST' ELSE '{X.OTHER_CLASS}|' || category END AS c FROM docs)"""),
    "document_states": (document_states, DOCS + "SELECT CASE WHEN extracted_text <> '' THEN 'keep' ELSE 'extract' END AS extraction, CASE id % 5 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'VALIDATED' WHEN 2 THEN 'VALIDATED' WHEN 3 THEN 'ERROR' ELSE ai_status END AS next, count(*) AS n FROM docs GROUP BY 1, 2"),
    "document_content": (document_content, DOCS + "SELECT id, ok AS is_document, ok AND id % 2 = 0 AS has_items, ok AND id % 3 = 0 AS has_warnings, CASE WHEN ok AND id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE '' END AS first_code, CAST(CASE WHEN ok AND id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_warnings FROM (SELECT *, id % 9 <> 0 AS ok FROM docs)"),
    "contracts_by_executions": (contracts_by_executions, DOCS + "SELECT project_id, contract_id, execution_id, i AS step, CAST(10 + floor(i / n * 70 + 0.5) AS BIGINT) AS progress FROM (SELECT c.project_id, c.id AS contract_id, e.id AS execution_id, row_number() OVER (PARTITION BY c.project_id ORDER BY c.id, e.id) - 1 AS i, count(*) OVER (PARTITION BY c.project_id) AS n FROM docs c JOIN docs e ON c.project_id = e.project_id AND c.category = 'CONTRACT' AND e.category = 'EXECUTION')"),
    "first_documents": (first_documents, DOCS + "SELECT project_id, category, min(id) AS id, arg_min(title, id) AS title FROM docs GROUP BY 1, 2"),
    "visible_findings": (visible_findings, f"WITH {V.FINDINGS_SQL}, {V.PROJECTS_SQL} SELECT id, project_id FROM findings WHERE project_id IN (SELECT id FROM projects WHERE contractor_id = 7)"),
    "chat_history": (chat_history, "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn < last"),
    "feed_state": (feed_state, f"WITH {V.CHANGES_SQL} SELECT id, seq, op, severity, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM changes) WHERE n = 1 AND op <> 'DELETE'"),
    "feed_open_high": (feed_open_high, f"WITH {V.CHANGES_SQL} SELECT count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM changes) WHERE n = 1 AND op <> 'DELETE' AND status = 'OPEN' AND severity = 'HIGH'"),
    "cascade_deletes": (cascade_deletes, f"WITH {V.FINDINGS_SQL}, {V.LEDGER_SQL}, {V.PROJECTS_SQL}, gone AS (SELECT id FROM projects WHERE budget < 0) SELECT (SELECT count(*) FROM findings WHERE project_id NOT IN (SELECT id FROM gone)) AS findings_left, (SELECT count(*) FROM ledger) AS rows_left, (SELECT count(*) FROM ledger WHERE project_id NOT IN (SELECT id FROM gone)) AS references_left"),
    "profiles_inserted": (profiles_inserted, f"WITH {V.FINDINGS_SQL}, {V.PROJECTS_SQL} SELECT id, name FROM projects WHERE id < 1000 UNION ALL SELECT DISTINCT project_id, 'new ' || project_id FROM findings WHERE project_id NOT IN (SELECT id FROM projects WHERE id < 1000)"),
    "text_markers": (text_markers, "SELECT p_partkey, CAST(i AS BIGINT) AS part_no, ['see ', '[1]', ' and ' || substr(p_name, 1, 4), '[2]', '[3] end', '[1]'][i + 1] AS part FROM part, range(6) t(i)"),
    "evidence_and_notes": (evidence_and_notes, f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '- plan (עמ'' 3)' || chr(10) || '- {X.EVIDENCE_DOCUMENT} (עמ'' ?)' ELSE '{X.NO_EVIDENCE}' END AS evidence, '{X.NOTE_KEYS['MARKET_ANALYSIS']}: m' || p_partkey || '; other: o' AS notes FROM part"),
    "scalar_formats": (scalar_formats, """SELECT o_orderkey, CASE WHEN o_orderkey % 150 < 10 THEN '0' ELSE '' END || (o_orderkey % 150) AS padded, CAST(floor((o_orderkey % 40 - 20) / 4 + 0.5) AS BIGINT) AS rounded, day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) AS day,
  right(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 6) AS tail, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 7 AS bucket, CASE WHEN o_orderkey % 2 = 0 THEN '—' ELSE 'x' END AS dashed, CAST(o_orderkey * 10 AS DOUBLE) AS parsed, '₪' || format('{:,.2f}', o_totalprice) AS shekels
  FROM (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split('project-' || o_orderkey || '-é', ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM orders)"""),
    "json_fields": (json_fields, "SELECT event_id, coalesce(props ->> '$.missing', props ->> '$.k', 'none') AS value FROM events"),
}
