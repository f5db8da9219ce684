"""Queries of one project: scans, search, approvals, letters, reports, documents and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import fixed as X, scalars as S
from claimspark.operators import changes, documents as D, findings as Fi, ledger as L, letters, pricelist, search, security
from claimspark.operators.pricelist import classified
from claimspark.sources import views as V
from claimspark.sources.shared import scratch
from claimspark.streaming import feeds, sinks

from .lists import CLASSIFIED, KEY, WORDS
from .money import LETTER_ITEMS, NET, ORDER, TIES, M, _letter_items, _sum

FINDINGS, DOCS = f"WITH {V.FINDINGS_SQL} ", f"WITH {V.DOCUMENTS_SQL} "
PROJECT = 8


def project_price_search(spark, sf):
    """What one project may see for the words."""
    return search.price_search(V.ledger(spark, sf), classified(V.items(spark, sf)), WORDS, KEY, V.lists(spark, sf), PROJECT)


def project_notes(spark, sf):
    return search.project_notes(classified(V.items(spark, sf)), V.lists(spark, sf), PROJECT)


def zero_match_questions(spark, sf):
    """Findings of which every third has a price."""
    f = V.findings(spark, sf).select("id")
    found = search.best_source(f, f.filter("id % 3 = 0").select("id", F.lit("DEKEL").alias("source"), F.lit(5).cast("decimal(15,2)").alias("price"), F.lit("1").alias("item_code")), "id")
    return search.with_questions(found, ["how much", "which unit"]).select("id", "match_found", F.array_join("questions", "|").alias("questions"))


def scan_inputs(spark, sf):
    """The digest of a context is made once a project."""
    docs = V.project_documents(spark, sf)
    digests = Fi.whole_contexts(Fi.scan_contexts(docs)).select("project_id", F.md5("context").alias("context_md5"))
    return Fi.scan_inputs(docs).join(digests, "project_id", "left").select("project_id", "work_id", "contract_id", "contract_title", "context_md5")


def scan_contexts(spark, sf):
    return Fi.scan_contexts(V.project_documents(spark, sf)).select("project_id", "id", F.md5("part").alias("part_md5"))


def scan_inputs_of_document(spark, sf):
    """The first work document that has text."""
    docs = V.project_documents(spark, sf)
    first = docs.filter("category = 'EXECUTION' and extracted_text <> ''").agg(F.min("id")).first()[0]
    return Fi.scan_inputs(docs, first).select("project_id", "work_id", "contract_id", "contract_title", F.md5("work_text").alias("work_md5"))


def work_analysis(spark, sf):
    """A canned answer for each work document."""
    inputs = Fi.scan_inputs(V.project_documents(spark, sf))
    answer = F.format_string('sure: [{"title":"t %s Powered by x","category":"שינוי","contract_quote":"q","expert_strategy":{"risk_assessment":"low"}},{"title":"b","category":null}] done', "work_id")
    rows = Fi.scanned(inputs.withColumn("response", F.when(F.col("work_id") % 5 > 0, answer).otherwise("nothing")))
    field = lambda p: F.get_json_object("evidence_data", f"$.{p}")
    return rows.select("project_id", "source_execution_doc_id", "target_contract_doc_id", "part", "title", "severity", "status", field("contract_title").alias("contract_title"), field("work_title").alias("work_title"), field("contract_quote").alias("quote"), field("expert_strategy.risk_assessment").alias("risk"))


def _approved(spark, sf):
    """An estimate for each open severe finding."""
    f = V.findings(spark, sf).withColumn("pricing_status", F.lit("PENDING"))
    k = F.col("id")
    made = f.filter("status = 'OPEN' and severity = 'HIGH'").select("project_id", F.when(k % 2 == 0, "APPROVED_VO").otherwise("").alias("type"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("item_code"), F.col("title").alias("description"), (k % 7 + 1).cast("decimal(12,2)").alias("quantity"), (k % 100).cast("decimal(15,2)").alias("unit_price_excl_vat"), F.lit(None).cast("decimal(5,4)").alias("markup_percentage"), k.alias("contradiction_id"))
    return L.approve(made, f, V.projects(spark, sf))


def estimate_approved(spark, sf):
    return _approved(spark, sf)[0].select("contradiction_id", "project_id", "project_name", "type", "source", "item_code", "markup_percentage", "total_price_excl_vat", "vat_amount", "total_price_incl_vat")


def findings_estimated(spark, sf):
    return _approved(spark, sf)[1].groupBy("pricing_status").agg(F.count("*").alias("n"))


def pending_queue(spark, sf):
    """The findings that wait for a price once others have one."""
    return Fi.pending_queue(_approved(spark, sf)[1]).groupBy("project_id").agg(F.count("*").alias("n"))


def findings_after_move(spark, sf):
    f = V.findings(spark, sf)
    return Fi.moved(f.withColumn("description", F.lit("")), f.filter("project_id = 8"))[0].groupBy("status").agg(F.count("*").alias("n"))


def orders_approved(spark, sf):
    chosen = V.findings(spark, sf).filter("severity = 'HIGH'").select(F.col("id").alias("letter_id"))
    return L.approve_orders(V.ledger(spark, sf), chosen, "letter_id").groupBy("type").agg(F.count("*").alias("n"), L.money_sum("total_price_excl_vat").alias("net"))


def estimate_defaults(spark, sf):
    """Suggestions of which some fields are missing or zero."""
    k = F.col("id")
    some = V.items(spark, sf).select("id", F.when(k % 3 > 0, "m").otherwise("").alias("unit"), (k % 4).cast("decimal(12,2)").alias("quantity"), F.when(k % 5 > 0, F.col("rate")).alias("price"), (k % 2 * 20).cast("int").alias("markup_percent"), F.when(k % 2 == 0, "NEW").otherwise("1.2").alias("item_code"))
    return L.estimate_defaults(some).select("id", "unit", "quantity", "price", F.col("markup_percent").cast("bigint").alias("markup_percent"), "source")


def items_page_counted(spark, sf):
    return pricelist.page_with_count(V.items(spark, sf).select("id", "item_code"), 1)


def distinct_segments(spark, sf):
    return pricelist.distinct_segments(V.items(spark, sf), "pricelist_id")


def short_export(spark, sf):
    rows = V.ledger(spark, sf).withColumn("item_code", F.when(F.col("item_id") % 3 > 0, F.col("item_id").cast("string")))
    return letters.short_csv_lines(rows, "project_id", ["created_at", "letter_id", *ORDER])


def short_totals(spark, sf):
    return L.short_totals(V.ledger(spark, sf), "project_id")


def letter_items(spark, sf):
    chosen = V.findings(spark, sf).filter("status = 'OPEN'").select(F.col("id").alias("letter_id"))
    return letters.letter_items(V.ledger(spark, sf).filter("type <> 'BASE_CONTRACT'"), chosen, "letter_id")


def appendix_rows(spark, sf):
    return letters.appendix(_letter_items(spark, sf), "letter_id", ORDER)


def evidence_summary(spark, sf):
    return letters.evidence_summary(_letter_items(spark, sf), "letter_id")


def report_rows(spark, sf):
    """Findings with evidence of several shapes."""
    k = F.col("id")
    evidence = F.when(k % 3 == 0, '{"clause_reference":"4.1","contract_quote":"c","financial_impact_desc":"high","expert_strategy":{"risk_assessment":"r"}}').when(k % 3 == 1, '{"work_quote":"w","business_value":"v","justification":"because","expert_strategy":{}}')
    f = V.findings(spark, sf).select("id", "category", "severity", evidence.alias("evidence_data"), F.lit("").alias("strategy_advice"), F.when(k % 2 == 0, F.col("title")).alias("description"))
    return Fi.report_rows(f)


def critical_by_word(spark, sf):
    f = V.findings(spark, sf)
    return f.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(Fi.critical(F.col("category"), F.col("severity"), whole_word=True)).alias("n_high"))


def letter_prefill(spark, sf):
    f = V.findings(spark, sf).withColumn("description", F.col("category"))
    return Fi.prefill(f, f.filter("project_id = 8"))


def tone_texts(spark, sf):
    tone = F.get(F.array(*[F.lit(x) for x in ("formal", "firm", "other")]), (F.col("p_partkey") % 3).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", letters.instruction(tone, {"formal": "be formal", "firm": "be firm"}).alias("text"))


def evidence_documents(spark, sf):
    """Evidence by id, by title in the project, and by neither."""
    docs, k = V.project_documents(spark, sf), F.col("id")
    evidence = docs.select(k.alias("n"), "project_id", F.when(k % 3 == 0, k + 1).alias("document_id"), F.when(k % 3 == 1, F.col("title")).alias("document_title"))
    return D.evidence_documents(evidence, docs).select("n", "found_id")


def contract_view(spark, sf):
    return D.contract_view(V.project_documents(spark, sf), "CONTRACT").select("id", "project_id", "title")


def _stored(spark, sf):
    """Every document as a stored file."""
    d, k = V.project_documents(spark, sf), F.col("id")
    url = F.when(k % 4 > 0, F.concat(F.lit("https://h/public/documents/"), "project_id", F.lit("/"), k.cast("string"), F.lit(".pdf")))
    return d.select("*", url.alias("file_url"), F.when(k % 3 == 0, "images").otherwise("documents").alias("bucket_id"), (k % 5).alias("owner"), F.lit(None).cast("string").alias("parsed_json"))


def stored_files(spark, sf):
    files = _stored(spark, sf)
    return security.stored_visible(files).groupBy(F.lit("read").alias("may")).agg(F.count("*").alias("n")).unionByName(security.stored_owned(files, 2).groupBy(F.lit("change").alias("may")).agg(F.count("*").alias("n")))


def documents_deleted(spark, sf):
    d = _stored(spark, sf)
    return D.deleted(d, d.filter("category = 'EXECUTION'"))[1]


def documents_confirmed(spark, sf):
    d = _stored(spark, sf)
    chosen = d.filter("id % 4 = 1").select("id", F.lit('{"a":1}').alias("json"))
    return D.confirmed(d, chosen).groupBy("ai_status", "parsed_json").agg(F.count("*").alias("n"))


def document_counts(spark, sf):
    return D.status_counts(V.project_documents(spark, sf), "project_id")


def owned_projects(spark, sf):
    p = V.projects(spark, sf).withColumn("created_at", F.when(F.col("id") % 5 > 0, F.col("id") % 40))
    return security.owned(p, 7).select("id", "name", "budget")


def project_by_key(spark, sf):
    return changes.lookup_row(V.projects(spark, sf), "id", PROJECT)


def toggled_ids(spark, sf):
    ids = V.projects(spark, sf).select("id")
    return changes.toggled(ids.filter("id % 2 = 0"), ids.filter("id % 3 = 0"))


def rows_inserted(spark, sf):
    """Projects that a table gets with a default budget, and what comes back."""
    have = V.projects(spark, sf).filter("id < 100")
    new = V.projects(spark, sf).filter("id >= 100").select("id", F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"))
    return changes.inserted(have, new, {"budget": F.lit(0), "name": F.lit("new")})[1]


def rows_deleted(spark, sf):
    """Findings without those that were ignored."""
    f = V.findings(spark, sf)
    return changes.delete_keys(f, f.filter("status = 'IGNORED'"), "id").groupBy("status").agg(F.count("*").alias("n"))


def boq_items(spark, sf):
    """Items of a model's bills of quantities, some fields missing, some answers no JSON."""
    p, k = V.table(spark, sf, "part"), F.col("p_partkey")
    item = F.to_json(F.struct(F.lit("p").alias("project_name"), F.array(F.struct(F.when(k % 3 > 0, k.cast("string")).alias("item_code"), F.col("p_name").alias("description"), F.when(k % 2 > 0, "m").alias("unit"), (k % 9).cast("double").alias("quantity"), F.when(k % 4 > 0, F.lit(2.5)).alias("unit_price_excl_vat"))).alias("items")))
    answers = p.select(k.alias("id"), F.when(k % 7 > 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).otherwise("sorry").alias("response"))
    return pricelist.items_of_model(answers)


def document_items(spark, sf):
    """Line items and warnings of parsed documents."""
    k = F.col("id")
    json = F.to_json(F.struct(F.struct(F.array(F.struct(k.cast("string").alias("code"), F.lit(1.5).alias("quantity")), F.struct(F.lit("x").alias("code"), k.cast("double").alias("quantity"))).alias("items")).alias("financial_data"), F.array(F.lit("w")).alias("warnings")))
    d = D.content(V.project_documents(spark, sf).withColumn("parsed_json", json))
    return D.content_items(d).select("id", "item_no", "code", "quantity").join(D.content_warnings(d).groupBy("id").agg(F.count("*").alias("n_warnings")), "id")


def documents_for_model(spark, sf):
    """Documents' bytes as a model reads them: base64 and kind."""
    d = V.project_documents(spark, sf)
    return d.select("id", F.base64(F.encode("title", "UTF-8")).alias("content"), D.mime_type(F.col("title"), F.lit("text/x")).alias("mime"))


def lists_registered(spark, sf):
    uploads = V.lists(spark, sf).select("project_id", F.lit(3).alias("user_id"), F.col("name").alias("list_name"), F.lit("a.pdf").alias("file_name"), F.lit("{}").alias("parsed_json"))
    return D.registered(uploads, "https://h/public", F.lit("2026-01-02 00:00:00").cast("timestamp"))


def first_profile(spark, sf):
    p = V.projects(spark, sf)
    return search.first_per_group(p, ["contractor_id"], [F.desc_nulls_last("budget"), F.col("id")]).filter("contractor_id = 7").select("id", "name")


def new_profiles(spark, sf):
    """Profiles that users without one get at log-in."""
    users = V.projects(spark, sf).select("id", F.when(F.col("id") % 3 > 0, F.to_json(F.struct(F.col("name").alias("full_name")))).otherwise('{"company_name":"c"}').alias("metadata"))
    have = security.profiles_of(users.filter("id % 2 = 0"))
    return changes.insert_missing(have, security.profiles_of(users, "User", ""), "id")


def rows_for_admin(spark, sf):
    """An administrator sees all projects' findings, another user their own."""
    people = V.projects(spark, sf).select("id", F.when(F.col("id") == 3, "super_admin").otherwise("contractor").alias("role"))
    f, p = V.findings(spark, sf), V.projects(spark, sf)
    seen = [security.visible(f, p, user, admin=security.is_admin(people, user)).agg(F.count("*").alias("n")).select(F.lit(user).alias("user"), "n") for user in (3, 4)]
    return seen[0].unionByName(seen[1])


def stream_inserts(spark, sf):
    """New findings of the feed, read as a stream."""
    return feeds.replayed(feeds.inserts(V.change_stream(spark, sf)), scratch(spark))


def stream_insert_counts(spark, sf):
    """Counts beside the rows, of a sink that may see a batch twice."""
    sinks.counted_inserts(V.change_stream(spark, sf), at := scratch(spark)).awaitTermination()
    return sinks.running_counts(spark, at)


def stream_open_high(spark, sf):
    """The sum of the stream's changes is the number of open severe findings."""
    return feeds.replayed(feeds.open_high_changes(V.change_stream(spark, sf)), scratch(spark)).agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("n"))


def more_formats(spark, sf):
    """Fixed decimals, currency without decimals, labels, reversed lists, a clock that is given."""
    price, now = F.col("o_totalprice").cast("decimal(15,2)"), F.lit("2026-01-02").cast("timestamp")
    letters_of = F.filter(F.split("o_orderpriority", ""), lambda x: x != "")
    return V.table(spark, sf, "orders").select("o_orderkey", S.to_fixed(price, 1).alias("fixed"), S.shekels((price.cast("bigint")), 0).alias("whole"), S.amount_label(F.col("o_orderkey") % 2).alias("label"), F.array_join(S.latest_first(letters_of), "").alias("reversed"), S.stamped(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")), now).cast("date").cast("string").alias("day"), S.number(F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey").cast("string")).otherwise("1x"))).alias("number"))


SHORT = f"""SELECT *, {NET} AS net FROM ledger"""
VAT_OF = f"CAST(n * CAST(0.18 AS DECIMAL(5,4)) AS {M})"
TITLES = "list_extract(['formal','firm','other'], CAST(p_partkey % 3 + 1 AS INT))"
APPROVED = f"WITH {V.FINDINGS_SQL}, {V.PROJECTS_SQL}, estimated AS (SELECT * FROM findings WHERE status = 'OPEN' AND severity = 'HIGH') "
STORED = f"WITH {V.DOCUMENTS_SQL}, stored AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'images' ELSE 'documents' END AS bucket_id, id % 5 AS owner FROM docs) "
CONTRACTS = "contracts AS (SELECT project_id, min(id) AS contract_id, arg_min(title, id) AS contract_title, string_agg('--- Document: ' || title || ' ---' || chr(10) || extracted_text, chr(10) || chr(10) ORDER BY id) FILTER (extracted_text <> '') AS context FROM docs WHERE category = 'CONTRACT' GROUP BY 1)"
WORKS = f"WITH {V.DOCUMENTS_SQL}, {CONTRACTS}, works AS (SELECT w.project_id, w.id AS work_id, w.title AS work_title, contract_id, contract_title, context FROM docs w LEFT JOIN contracts c ON w.project_id = c.project_id WHERE w.category = 'EXECUTION' AND extracted_text <> '') "
HITS = "(description ILIKE '%ring%' OR description ILIKE '%wid%et%')"
EVIDENCE = f"{LETTER_ITEMS}, shown AS (SELECT *, coalesce(notes <> '', false) OR coalesce(ai_rationale <> '', false) AS there FROM letter_items) "

QUERIES = {
    "project_price_search": (project_price_search, f"""WITH {V.LEDGER_SQL}, {V.LISTS_SQL}, {CLASSIFIED.removeprefix("WITH ")},
contract AS (SELECT * FROM ledger WHERE project_id = {PROJECT} AND type = 'BASE_CONTRACT' AND {HITS} ORDER BY {", ".join(KEY)} LIMIT 30),
hits AS (SELECT * FROM classified WHERE item_type IN ('ITEM', 'NOTE') AND {HITS} AND pricelist_id IN (SELECT id FROM lists WHERE is_global OR project_id = {PROJECT}) ORDER BY id LIMIT 50),
prefixes AS (SELECT DISTINCT array_to_string(list_slice(string_split(item_code, '.'), 1, n), '.') AS prefix FROM hits, (VALUES (1), (2), (3)) t(n) WHERE item_type = 'ITEM'),
notes AS (SELECT * FROM classified c WHERE item_type = 'NOTE' AND EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(c.item_code, p.prefix)) ORDER BY id LIMIT 40),
found AS (SELECT * FROM hits UNION ALL SELECT * FROM notes WHERE id NOT IN (SELECT id FROM hits))
SELECT 'CONTRACT ITEM' AS tag, {" || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in KEY)} AS ref, description FROM contract UNION ALL SELECT CASE WHEN item_type = 'NOTE' THEN 'GOVERNING NOTE' ELSE 'EXTERNAL ITEM' END, CAST(id AS VARCHAR), description FROM found"""),
    "project_notes": (project_notes, f"WITH {V.LISTS_SQL}, {CLASSIFIED.removeprefix('WITH ')} SELECT c.id, item_code, description, name AS list_name FROM classified c JOIN lists l ON c.pricelist_id = l.id WHERE item_type = 'NOTE' AND project_id = {PROJECT} ORDER BY c.id LIMIT 50"),
    "zero_match_questions": (zero_match_questions, FINDINGS + "SELECT id, id % 3 = 0 AS match_found, CASE WHEN id % 3 = 0 THEN '' ELSE 'how much|which unit' END AS questions FROM findings"),
    "scan_inputs": (scan_inputs, WORKS + "SELECT project_id, work_id, contract_id, contract_title, md5(context) AS context_md5 FROM works"),
    "scan_contexts": (scan_contexts, f"WITH {V.DOCUMENTS_SQL} SELECT project_id, id, md5('--- Document: ' || title || ' ---' || chr(10) || extracted_text) AS part_md5 FROM docs WHERE category = 'CONTRACT' AND extracted_text <> ''"),
    "scan_inputs_of_document": (scan_inputs_of_document, WORKS + "SELECT w.project_id, work_id, contract_id, contract_title, md5(extracted_text) AS work_md5 FROM works w JOIN docs ON id = work_id WHERE work_id = (SELECT min(work_id) FROM works)"),
    "work_analysis": (work_analysis, WORKS + f"SELECT project_id, work_id AS source_execution_doc_id, contract_id AS target_contract_doc_id, part, CASE part WHEN 0 THEN 't ' || work_id ELSE 'b' END AS title, CASE part WHEN 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'OPEN' AS status, coalesce(contract_title, '{X.CONTRACT_TITLE}') AS contract_title, work_title, CASE part WHEN 0 THEN 'q' END AS quote, CASE part WHEN 0 THEN 'low' END AS risk FROM works, (VALUES (0), (1)) p(part) WHERE work_id % 5 > 0"),
    "estimate_approved": (estimate_approved, APPROVED + f"""SELECT e.id AS contradiction_id, project_id, name AS project_name, CASE WHEN e.id % 2 = 0 THEN 'APPROVED_VO' ELSE 'PENDING_VO' END AS type, 'CUSTOM_ANALYSIS' AS source, '' AS item_code, CAST(0 AS DECIMAL(5,4)) AS markup_percentage,
  CAST((e.id % 7 + 1) * (e.id % 100) AS DECIMAL(15,2)) AS total_price_excl_vat, CAST((e.id % 7 + 1) * (e.id % 100) * CAST(0.18 AS DECIMAL(5,4)) AS DECIMAL(15,2)) AS vat_amount, CAST((e.id % 7 + 1) * (e.id % 100) * CAST(1.18 AS DECIMAL(5,4)) AS DECIMAL(15,2)) AS total_price_incl_vat FROM estimated e LEFT JOIN projects p ON p.id = e.project_id"""),
    "findings_estimated": (findings_estimated, FINDINGS + "SELECT CASE WHEN status = 'OPEN' AND severity = 'HIGH' THEN 'ESTIMATED' ELSE 'PENDING' END AS pricing_status, count(*) AS n FROM findings GROUP BY 1"),
    "pending_queue": (pending_queue, FINDINGS + "SELECT project_id, count(*) AS n FROM findings WHERE NOT (status = 'OPEN' AND severity = 'HIGH') GROUP BY 1"),
    "findings_after_move": (findings_after_move, FINDINGS + "SELECT CASE WHEN project_id = 8 THEN 'MOVED_TO_PRICING' ELSE status END AS status, count(*) AS n FROM findings GROUP BY 1"),
    "orders_approved": (orders_approved, f"WITH {V.LEDGER_SQL}, {V.FINDINGS_SQL} SELECT CASE WHEN l.type = 'PENDING_VO' AND f.id IS NOT NULL THEN 'APPROVED_VO' ELSE l.type END AS type, count(*) AS n, {_sum('total_price_excl_vat')} AS net FROM ledger l LEFT JOIN (SELECT id FROM findings WHERE severity = 'HIGH') f ON l.letter_id = f.id GROUP BY 1"),
    "estimate_defaults": (estimate_defaults, f"WITH {V.ITEMS_SQL} SELECT id, CASE WHEN id % 3 > 0 THEN 'm' ELSE '{X.AREA_UNIT}' END AS unit, CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE id % 4 END AS DECIMAL(12,2)) AS quantity, CAST(CASE WHEN id % 5 > 0 THEN rate ELSE 0 END AS DECIMAL(15,2)) AS price, CAST(CASE WHEN id % 2 = 0 THEN 15 ELSE 20 END AS BIGINT) AS markup_percent, CASE WHEN id % 2 = 0 THEN 'CUSTOM_ANALYSIS' ELSE 'BOQ' END AS source FROM items"),
    "items_page_counted": (items_page_counted, f"WITH {V.ITEMS_SQL} SELECT id, item_code, (SELECT count(*) FROM items) AS n_all, (SELECT count(*) FROM items) >= 200 AS has_more FROM items ORDER BY item_code, id LIMIT 100 OFFSET 100"),
    "distinct_segments": (distinct_segments, f"WITH {V.ITEMS_SQL} SELECT pricelist_id, chapter, string_agg(second, ',' ORDER BY second) AS seconds FROM (SELECT DISTINCT pricelist_id, string_split(item_code, '.')[1] AS chapter, string_split(item_code, '.')[2] AS second FROM items WHERE item_code <> '') GROUP BY 1, 2"),
    "short_export": (short_export, f"""WITH {V.LEDGER_SQL}, rows AS ({SHORT}), sums AS (SELECT project_id, CAST(sum(net) AS {M}) AS n FROM (SELECT project_id, CAST(net AS {M}) AS net FROM rows) GROUP BY 1)
SELECT project_id, 0 AS section, 0 AS place, chr(65279) || '{",".join(X.SHORT_HEADERS).replace("'", "''")}' AS line FROM sums
UNION ALL SELECT project_id, 1, row_number() OVER (PARTITION BY project_id ORDER BY created_at, letter_id, {TIES}), concat_ws(',', CASE WHEN item_id % 3 > 0 THEN CAST(item_id AS VARCHAR) ELSE '' END, '"' || description || '"', unit, CAST(quantity AS VARCHAR), CAST(unit_price_excl_vat AS VARCHAR), CAST(CAST(net AS {M}) AS VARCHAR)) FROM rows
UNION ALL SELECT project_id, 2, 0, '' FROM sums UNION ALL SELECT project_id, 2, 1, ',,,,{X.SHORT_TOTALS[0].replace("'", "''")},' || n FROM sums
UNION ALL SELECT project_id, 2, 2, ',,,,{X.SHORT_TOTALS[1].format(18).replace("'", "''")},' || {VAT_OF} FROM sums UNION ALL SELECT project_id, 2, 3, ',,,,{X.SHORT_TOTALS[2].replace("'", "''")},' || CAST(n + {VAT_OF} AS {M}) FROM sums"""),
    "short_totals": (short_totals, f"WITH {V.LEDGER_SQL}, sums AS (SELECT project_id, CAST(sum(net) AS {M}) AS n FROM ({SHORT}) GROUP BY 1) SELECT project_id, n AS subtotal, {VAT_OF} AS vat, CAST(n + {VAT_OF} AS {M}) AS total FROM sums"),
    "letter_items": (letter_items, f"WITH {V.LEDGER_SQL}, {V.FINDINGS_SQL} SELECT letter_id, description, unit, quantity, unit_price_excl_vat AS unit_price, CAST(total_price_excl_vat AS {M}) AS total FROM ledger WHERE type <> 'BASE_CONTRACT' AND letter_id IN (SELECT id FROM findings WHERE status = 'OPEN')"),
    "appendix_rows": (appendix_rows, EVIDENCE + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY letter_id ORDER BY {TIES}) AS number FROM shown WHERE there)
SELECT letter_id, number, '[' || item_code || '] ' || description AS heading, coalesce(ai_rationale, '{X.DEFAULT_RATIONALE}') AS rationale, k AS source_no,
  CASE item_id % 5 WHEN 0 THEN ['{{"text":"first"}}', '{{"page":2}}', 'third'][k + 1] WHEN 1 THEN '{{"instruction":"do it"}}' WHEN 2 THEN '{{"note":"see plan"}}' WHEN 3 THEN 'plain words' ELSE '{X.NO_SOURCES}' END AS source
FROM numbered, (VALUES (0), (1), (2)) t(k) WHERE k = 0 OR item_id % 5 = 0"""),
    "evidence_summary": (evidence_summary, EVIDENCE + "SELECT letter_id, bool_or(there) AS any_evidence, bool_and(NOT there) AS no_evidence, count(*) FILTER (there) AS n_evidence, greatest(count(*) FILTER (there) - 3, 0) AS n_more FROM shown GROUP BY 1"),
    "report_rows": (report_rows, FINDINGS + f"""SELECT id, id % 3 = 0 AS has_expert, CASE WHEN id % 3 = 0 THEN '4.1' ELSE coalesce(category, '{X.GENERAL_CLAUSE}') END AS clause, coalesce(category, CASE severity WHEN 'HIGH' THEN '{X.CONTRADICTION_WORD}' WHEN 'MEDIUM' THEN '{X.SHORT_CHANGE}' ELSE '{X.SITE_EVENT}' END) AS label,
  CASE WHEN id % 3 = 0 THEN 'c' ELSE '—' END AS contract_quote, CASE WHEN id % 3 = 1 THEN 'w' ELSE '—' END AS work_quote, CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'v' ELSE '—' END AS financial, CASE WHEN id % 3 = 0 THEN 'r' ELSE '—' END AS risk,
  CASE WHEN id % 3 = 0 THEN '—' WHEN id % 3 = 1 THEN 'because' WHEN id % 2 = 0 THEN title ELSE '—' END AS advice FROM findings"""),
    "critical_by_word": (critical_by_word, FINDINGS + f"SELECT project_id, count(*) AS n, count(*) FILTER (coalesce(category = '{X.CONTRADICTION_WORD}', false) OR severity = 'HIGH') AS n_high FROM findings GROUP BY 1"),
    "letter_prefill": (letter_prefill, FINDINGS + f"SELECT id, '{X.LETTER_SUBJECT}' || title AS subject, '{X.LETTER_POINTS[0]}' || coalesce(category, '') || '{X.LETTER_POINTS[1]}' AS key_points FROM findings WHERE project_id = 8 ORDER BY created_at, id LIMIT 1"),
    "tone_texts": (tone_texts, f"SELECT p_partkey, CASE {TITLES} WHEN 'formal' THEN 'be formal' WHEN 'firm' THEN 'be firm' ELSE '{X.DEFAULT_TONE}' END AS text FROM part"),
    "evidence_documents": (evidence_documents, DOCS + "SELECT d.id AS n, CASE WHEN d.id % 3 = 0 THEN n.id WHEN d.id % 3 = 1 THEN t.id END AS found_id FROM docs d LEFT JOIN docs n ON n.id = d.id + 1 LEFT JOIN (SELECT project_id, title, min(id) AS id FROM docs GROUP BY 1, 2) t ON t.project_id = d.project_id AND t.title = d.title"),
    "contract_view": (contract_view, DOCS + "SELECT id, project_id, title FROM docs WHERE category = 'CONTRACT' OR " + " OR ".join(f"contains(title, '{w}')" for w in X.CONTRACT_TITLE_WORDS)),
    "stored_files": (stored_files, STORED + "SELECT 'read' AS may, count(*) AS n FROM stored WHERE bucket_id = 'documents' UNION ALL SELECT 'change', count(*) FROM stored WHERE bucket_id = 'documents' AND owner = 2"),
    "documents_deleted": (documents_deleted, STORED + "SELECT id, project_id || '/' || id || '.pdf' AS path FROM stored WHERE category = 'EXECUTION' AND id % 4 > 0"),
    "documents_confirmed": (documents_confirmed, STORED + """SELECT CASE WHEN id % 4 = 1 THEN 'VALIDATED' ELSE ai_status END AS ai_status, CASE WHEN id % 4 = 1 THEN '{"a":1}' END AS parsed_json, count(*) AS n FROM stored GROUP BY 1, 2"""),
    "document_counts": (document_counts, DOCS + "SELECT project_id, count(*) AS n, count(*) FILTER (ai_status = 'VALIDATED') AS n_validated, count(*) FILTER (category = 'CONTRACT') AS n_contracts, count(*) FILTER (category = 'EXECUTION') AS n_executions FROM docs GROUP BY 1"),
    "owned_projects": (owned_projects, f"WITH {V.PROJECTS_SQL} SELECT id, name, budget FROM projects WHERE contractor_id = 7"),
    "project_by_key": (project_by_key, f"WITH {V.PROJECTS_SQL} SELECT * FROM projects WHERE id = {PROJECT}"),
    "toggled_ids": (toggled_ids, f"WITH {V.PROJECTS_SQL} SELECT id FROM projects WHERE (id % 2 = 0) <> (id % 3 = 0)"),
    "rows_inserted": (rows_inserted, f"WITH {V.PROJECTS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE 'new' END AS name, CAST(NULL AS INTEGER) AS contractor_id, CAST(0 AS DECIMAL(15,2)) AS budget FROM projects WHERE id >= 100"),
    "rows_deleted": (rows_deleted, FINDINGS + "SELECT status, count(*) AS n FROM findings WHERE status <> 'IGNORED' GROUP BY 1"),
    "boq_items": (boq_items, "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS item_code, p_name AS description, 'ITEM' AS item_type, CASE WHEN p_partkey % 2 > 0 THEN 'm' ELSE '' END AS unit, CAST(p_partkey % 9 AS DECIMAL(12,2)) AS quantity, CAST(CASE WHEN p_partkey % 4 > 0 THEN 2.5 ELSE 0 END AS DECIMAL(15,2)) AS rate FROM part WHERE p_partkey % 7 > 0"),
    "document_items": (document_items, DOCS + "SELECT id, k AS item_no, CASE k WHEN 0 THEN CAST(id AS VARCHAR) ELSE 'x' END AS code, CASE k WHEN 0 THEN 1.5 ELSE CAST(id AS DOUBLE) END AS quantity, CAST(1 AS BIGINT) AS n_warnings FROM docs, (VALUES (0), (1)) t(k)"),
    "documents_for_model": (documents_for_model, DOCS + "SELECT id, to_base64(encode(title)) AS content, CASE WHEN lower(title) LIKE '%.pdf' THEN 'application/pdf' WHEN lower(title) LIKE '%.jpg' THEN 'image/jpeg' ELSE 'text/x' END AS mime FROM docs"),
    "lists_registered": (lists_registered, f"WITH {V.LISTS_SQL} SELECT project_id, name AS title, 'PRICELIST' AS category, 'https://h/public/documents/3/1767312000000_a.pdf' AS file_url, 'DONE' AS ai_status, '{{}}' AS parsed_json FROM lists"),
    "first_profile": (first_profile, f"WITH {V.PROJECTS_SQL} SELECT id, name FROM projects WHERE contractor_id = 7 ORDER BY budget DESC, id LIMIT 1"),
    "new_profiles": (new_profiles, f"WITH {V.PROJECTS_SQL} SELECT id, CASE WHEN id % 3 > 0 THEN name WHEN id % 2 > 0 THEN 'User' END AS full_name, CASE WHEN id % 3 = 0 THEN 'c' WHEN id % 2 > 0 THEN '' END AS company_name, 'contractor' AS role FROM projects"),
    "rows_for_admin": (rows_for_admin, f"WITH {V.FINDINGS_SQL}, {V.PROJECTS_SQL} SELECT 3 AS user, count(*) AS n FROM findings UNION ALL SELECT 4, count(*) FROM findings WHERE project_id IN (SELECT id FROM projects WHERE contractor_id = 4)"),
    "stream_inserts": (stream_inserts, f"WITH {V.CHANGES_SQL} SELECT seq, id, severity, status FROM changes WHERE op = 'INSERT'"),
    "stream_insert_counts": (stream_insert_counts, f"WITH {V.CHANGES_SQL} SELECT severity, count(*) AS n FROM changes WHERE op = 'INSERT' GROUP BY 1"),
    "stream_open_high": (stream_open_high, f"WITH {V.CHANGES_SQL} SELECT count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM changes) WHERE n = 1 AND op <> 'DELETE' AND status = 'OPEN' AND severity = 'HIGH'"),
    "more_formats": (more_formats, f"""SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(38,1)) AS VARCHAR) AS fixed, '₪' || format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS whole, CASE WHEN o_orderkey % 2 > 0 THEN '{X.ACTIVE_LABEL}' ELSE '{X.CLEAN_LABEL}' END AS label, reverse(o_orderpriority) AS reversed, CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '2026-01-02' END AS day, CAST(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey ELSE 0 END AS DOUBLE) AS number FROM orders"""),
}
