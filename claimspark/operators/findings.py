"""Findings: parsing of text-model output, severity, queues, insights and scan control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions import fixed as X
from claimspark.functions.scalars import dash, has_text, ordinal, outer_array, text_or, without_attribution

from .changes import update_keys

FINDING = "array<struct<title:string,description:string,category:string,advice:string,clause_reference:string,contract_page:string,work_page:string,original_instruction:string,new_requirement:string,contract_quote:string,work_quote:string,expert_strategy:struct<risk_assessment:string,financial_impact_desc:string>>>"


def severity(category: Column) -> Column:
    return F.when(category.contains(X.CONTRADICTION_WORD), "HIGH").when(category.contains(X.CHANGE_WORD), "MEDIUM").otherwise("LOW")


def shown_as(category: Column, level: Column) -> Column:
    c = F.coalesce(category, F.lit(""))
    change = c.contains(X.CHANGE_WORD) | c.contains(X.INSTRUCTION_WORD) | (level == "MEDIUM")
    return F.when(c.contains(X.CONTRADICTION_WORD) | (level == "HIGH"), X.CONTRADICTION_LABEL).when(change, X.CHANGE_LABEL).otherwise(X.SITE_EVENT_LABEL)


def critical(category: Column, level: Column, whole_word: bool = False) -> Column:
    named = category == X.CONTRADICTION_WORD if whole_word else category.contains(X.CONTRADICTION_WORD)
    return F.coalesce(named, F.lit(False)) | F.coalesce(level == "HIGH", F.lit(False))


def clean(text: Column) -> Column:
    return without_attribution(text, X.ATTRIBUTIONS)


def parsed(responses: DataFrame, column: str = "response") -> DataFrame:
    """One row a finding in each response's outermost JSON array, with severity, clean texts and evidence as JSON; other responses have none."""
    keep = [c for c in responses.columns if c != column]
    rows = responses.select(*keep, F.posexplode(F.from_json(outer_array(F.col(column)), FINDING)).alias("part", "f"))
    evidence = F.to_json(F.struct("f.clause_reference", "f.contract_page", "f.work_page", "f.original_instruction", "f.new_requirement", "f.contract_quote", "f.work_quote", "f.expert_strategy"))
    return rows.select(*keep, "part", clean(F.col("f.title")).alias("title"), clean(F.col("f.description")).alias("description"), F.col("f.category").alias("category"), severity(F.col("f.category")).alias("severity"), clean(F.col("f.advice")).alias("strategy_advice"), evidence.alias("evidence_data"))


def merge_strategy(evidence: Column, strategy: Column) -> Column:
    """JSON text with expert_strategy replaced, also by null; the other fields stay."""
    kept = F.map_filter(F.from_json(F.coalesce(evidence, F.lit("{}")), "map<string,variant>"), lambda k, _: k != "expert_strategy")
    value = F.coalesce(F.parse_json(strategy), F.parse_json(F.lit("null")))
    return F.to_json(F.map_concat(kept, F.create_map(F.lit("expert_strategy"), value)))


def by_severity(findings: DataFrame, most_severe_first: bool = False) -> list:
    """Sort keys: declared order from the end (LOW, MEDIUM, HIGH), newest first, then id; or the most severe first."""
    rank = ordinal(F.col("severity"), X.SEVERITIES)
    return [rank.asc_nulls_last() if most_severe_first else rank.desc_nulls_first(), F.desc_nulls_first("created_at"), F.col("id")]


def queue(findings: DataFrame, statuses: list[str]) -> DataFrame:
    """Findings of the statuses; a missing pricing status is a pending one."""
    status = text_or(F.col("pricing_status"), F.lit("PENDING")) if "pricing_status" in findings.columns else F.lit("PENDING")
    return findings.filter(F.col("status").isin(statuses)).withColumn("pricing_status", status)


def pending_queue(findings: DataFrame) -> DataFrame:
    """The other definition: findings whose stored pricing status is pending, whatever their status."""
    return findings.filter(F.col("pricing_status") == "PENDING")


def grouped_queue(rows: DataFrame, title: str, default: str) -> DataFrame:
    """Groups by title (missing: default) with counts, places and first row in order of creation."""
    group = text_or(F.col(title), F.lit(default)).alias("group_title")
    firsts = rows.groupBy(group).agg(F.count("*").alias("n_findings"), F.min(F.struct("created_at", "id")).alias("f"))
    return firsts.select("group_title", "n_findings", F.col("f.created_at").alias("first_seen"), F.col("f.id").alias("first_id"))


def insights(findings: DataFrame, ledger: DataFrame, most_findings: int = 5, most_orders: int = 3) -> DataFrame:
    """The first open findings by severity and the first pending orders, in one shape."""
    some = findings.filter(F.col("status") == "OPEN").orderBy(*by_severity(findings)).limit(most_findings)
    orders = ledger.filter(F.col("type") == "PENDING_VO").orderBy("letter_id", "line_no", "item_id").limit(most_orders)
    a = some.select(F.col("id").cast("string").alias("ref"), F.lit("contradiction").alias("type"), "severity", "title", F.lit(None).cast("decimal(15,2)").alias("amount"))
    title = F.concat(F.lit(X.PENDING_VO_PREFIX), text_or(F.col("description"), F.lit(X.NO_DESCRIPTION)))
    b = orders.select(F.concat_ws("/", "letter_id", "line_no", "item_id").alias("ref"), F.lit("risk").alias("type"), F.lit("MEDIUM").alias("severity"), title.alias("title"), F.coalesce("total_price_excl_vat", F.lit(0)).cast("decimal(15,2)").alias("amount"))
    return a.unionByName(b)


def scan_control(findings: DataFrame, project: object, force: bool = False, work_document: object | None = None) -> tuple[DataFrame, bool]:
    """(findings that stay, whether to scan the project).

    Forced, all of the project's findings go, whatever the document; else a work document's own go; with neither all stay, and
    the project is scanned only if it has none.
    """
    own = F.coalesce(F.col("project_id") == F.lit(project), F.lit(False))
    if force:
        return findings.filter(~own), True
    if work_document is not None:
        return findings.filter(~(own & F.coalesce(F.col("source_execution_doc_id") == F.lit(work_document), F.lit(False)))), True
    return findings, findings.filter(own).isEmpty()


def scan_contexts(docs: DataFrame) -> DataFrame:
    """What a scan holds work documents against, once a project: (project_id, id, part) of its contracts with text, to be read in the order of ids."""
    line = F.concat(F.lit("--- Document: "), F.col("title"), F.lit(" ---\n"), F.col("extracted_text"))
    return docs.filter(F.col("category").isin(X.CONTRACT_CATEGORIES) & has_text(F.col("extracted_text"))).select("project_id", "id", line.alias("part"))


def whole_contexts(contexts: DataFrame) -> DataFrame:
    """(project_id, context): the parts as one text, a row a project, for a model that reads it at once. It is as long as the project's contracts."""
    lines = F.array_sort(F.collect_list(F.struct("id", "part")))
    return contexts.groupBy("project_id").agg(F.array_join(F.transform(lines, lambda x: x["part"]), "\n\n").alias("context"))


def scan_inputs(docs: DataFrame, work_document: object | None = None) -> DataFrame:
    """One row a work document with text: project_id, which is the key of its context, work_id, work_title, work_text, and the first id and title of its project's contracts.

    The context itself isn't copied to every work document. A work document that is asked for and isn't there is an error; one without text gives no row.
    """
    first = docs.filter(F.col("category").isin(X.CONTRACT_CATEGORIES)).groupBy("project_id").agg(F.min(F.struct("id", "title")).alias("f"))
    contracts = first.select("project_id", F.col("f.id").alias("contract_id"), F.col("f.title").alias("contract_title"))
    work = docs.filter(F.col("category").isin(X.WORK_CATEGORIES))
    if work_document is not None:
        work = work.filter(F.col("id") == F.lit(work_document))
        if work.isEmpty():
            raise LookupError(f"no work document {work_document}")
    work = work.filter(has_text(F.col("extracted_text")))
    return work.select("project_id", F.col("id").alias("work_id"), F.col("title").alias("work_title"), F.col("extracted_text").alias("work_text")).join(contracts, "project_id", "left")


def scanned(answers: DataFrame, column: str = "response") -> DataFrame:
    """New findings from the model's answers to scan_inputs: open, with their documents; evidence as JSON. Answers without a JSON array have none."""
    keep = ["project_id", "work_id", "work_title", "contract_id", "contract_title"]
    rows = parsed(answers.select(*keep, column), column)
    named = F.map_from_arrays(F.array(F.lit("contract_title"), F.lit("work_title")), F.array(text_or(F.col("contract_title"), F.lit(X.CONTRACT_TITLE)), F.col("work_title")))
    evidence = F.map_concat(F.from_json("evidence_data", "map<string,variant>"), F.transform_values(named, lambda k, v: F.try_variant_get(F.parse_json(F.to_json(F.struct(v.alias("v")))), "$.v", "variant")))
    return rows.select("project_id", "part", "title", "description", "severity", "category", "strategy_advice", F.col("work_id").alias("source_execution_doc_id"), F.col("contract_id").alias("target_contract_doc_id"), F.lit("OPEN").alias("status"), F.to_json(evidence).alias("evidence_data"))


def moved(findings: DataFrame, chosen: DataFrame, status: str = "MOVED_TO_PRICING") -> tuple[DataFrame, DataFrame]:
    """(findings with the chosen ones' status, the ledger rows that come of them)."""
    own = findings.join(chosen.select("id").distinct(), "id", "left_semi")
    return update_keys(findings, chosen, "id", {"status": F.lit(status)}), as_ledger_row(own)


def report_rows(findings: DataFrame, evidence: str = "evidence_data") -> DataFrame:
    """Lines of the printed report: clause, class, quotes, financial text, risk, and advice where there is no expert analysis; a dash for what is missing."""
    field = lambda *path: F.get_json_object(evidence, "$." + ".".join(path))
    level, e = F.col("severity"), F.lit("")
    label = F.when(level == "HIGH", X.CONTRADICTION_WORD).when(level == "MEDIUM", X.SHORT_CHANGE).otherwise(X.SITE_EVENT)
    expert = F.coalesce(F.size(F.json_object_keys(F.get_json_object(evidence, "$.expert_strategy"))) > 0, F.lit(False))
    advice = text_or(F.col("strategy_advice"), field("strategy_advice"), field("justification"), F.col("description"), e)
    lines = {
        "clause": text_or(field("clause_reference"), F.col("category"), F.lit(X.GENERAL_CLAUSE)), "label": text_or(F.col("category"), label), "contract_quote": field("contract_quote"), "work_quote": field("work_quote"),
        "financial": text_or(field("financial_impact_desc"), field("business_value"), e), "risk": F.when(expert, field("expert_strategy", "risk_assessment")), "advice": F.when(~expert, advice),
    }
    return findings.select("id", expert.alias("has_expert"), *[dash(c).alias(k) for k, c in lines.items()])


def prefill(findings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Subject and points of a letter from the first of the chosen findings by creation and id; no row without one."""
    first = findings.join(chosen.select("id").distinct(), "id", "left_semi").orderBy(F.asc_nulls_last("created_at"), "id").limit(1)
    points = F.concat(F.lit(X.LETTER_POINTS[0]), F.coalesce("description", F.lit("")), F.lit(X.LETTER_POINTS[1]))
    return first.select("id", F.concat(F.lit(X.LETTER_SUBJECT), F.coalesce("title", F.lit(""))).alias("subject"), points.alias("key_points"))


def as_ledger_row(finding: DataFrame) -> DataFrame:
    """Ledger rows of findings that move to pricing."""
    return finding.select("project_id", F.lit("PENDING_VO").alias("type"), F.lit("CUSTOM_ANALYSIS").alias("source"), text_or(F.col("description"), F.col("title")).alias("description"), F.lit(1).cast("decimal(12,2)").alias("quantity"), F.lit(0).cast("decimal(15,2)").alias("unit_price_excl_vat"), F.col("id").alias("contradiction_id"))


def context(rows: DataFrame, key: str, line: Column, order: list[str], most: int) -> DataFrame:
    """Per key the first `most` lines in order, joined by line feeds."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most)
    lines = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("_l"))
    return lines.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("context"))


def status_counts(findings: DataFrame, *keys: str) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(is_("OPEN")).alias("n_open"), F.count_if(is_("OPEN") & (F.col("severity") == "HIGH")).alias("n_open_high"), F.count_if(critical(F.col("category"), F.col("severity"))).alias("n_critical"), F.count_if(has_text(F.col("category"))).alias("n_categorised"))
