"""Money: stored amounts, splits, KPIs, selections and estimates, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.fixed import AREA_UNIT, DEFAULT_MARKUP_PERCENT, VAT_RATE
from claimspark.functions.scalars import has_number, has_text, number_or, round_half_up, text_or

from .changes import update_keys, with_parent

MONEY = "decimal(18,2)"


def with_amounts(rows: DataFrame) -> DataFrame:
    """rows with net, VAT and gross, each rounded once from the exact product of quantity, price and rate."""
    net, r = F.col("quantity") * F.col("unit_price_excl_vat"), F.col("vat_rate")
    amounts = {"total_price_excl_vat": net, "vat_amount": net * r, "total_price_incl_vat": net * (1 + r)}
    return rows.withColumns({k: v.cast("decimal(15,2)") for k, v in amounts.items()})


def repair_vat(rows: DataFrame, old: str, new: str = VAT_RATE) -> DataFrame:
    """Rows of the old rate get the new one; amounts are made again."""
    rate = F.when(F.col("vat_rate") == F.lit(old).cast("decimal(5,4)"), F.lit(new).cast("decimal(5,4)")).otherwise(F.col("vat_rate"))
    return with_amounts(rows.withColumn("vat_rate", rate))


def money_sum(c: str | Column, when: Column | None = None) -> Column:
    """A decimal sum, 0 over no rows."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast(MONEY)


def split_by_contract(rows: DataFrame, *keys: str) -> DataFrame:
    """Base and other sums, stored totals, and VAT taken from the subtotal, which may differ from the stored VAT by rounding."""
    base = F.col("type") == "BASE_CONTRACT"
    out = rows.groupBy(*keys).agg(
        money_sum("total_price_excl_vat", base).alias("base_net"), money_sum("total_price_excl_vat", ~base).alias("other_net"),
        money_sum("total_price_incl_vat", base).alias("base_gross"), money_sum("total_price_incl_vat", ~base).alias("other_gross"),
        money_sum("total_price_excl_vat").alias("net"), money_sum("vat_amount").alias("vat"), money_sum("total_price_incl_vat").alias("gross"),
    )
    return out.withColumn("vat_of_subtotal", (F.col("net") * F.lit(VAT_RATE).cast("decimal(5,4)")).cast(MONEY))


def net_or_product() -> Column:
    """The stored net; where it is missing or zero, quantity times price."""
    product = (F.coalesce("quantity", F.lit(0)) * F.coalesce("unit_price_excl_vat", F.lit(0))).cast("decimal(28,4)")
    return number_or(F.col("total_price_excl_vat").cast("decimal(28,4)"), product)


def has_evidence(rationale: str = "ai_rationale", notes: str | None = None) -> Column:
    there = has_text(F.col(rationale))
    return there | has_text(F.col(notes)) if notes else there


def percent(part: Column, whole: Column) -> Column:
    """Rounded share in percent, 0 of nothing."""
    return F.when(whole > 0, round_half_up(100 * part / whole)).otherwise(0).cast("bigint")


#: What KPIs are made of: sums of money and counts.
KPI_AMOUNTS, KPI_COUNTS = ["base", "approved", "approved_or_sent", "pending"], ["n_rows", "n_evidence"]


def kpi_parts() -> dict[str, Column]:
    """What one ledger row adds to each KPI sum and count."""
    t, n = F.col("type"), net_or_product().cast(MONEY)
    amount = lambda when: F.when(when, n).otherwise(F.lit(0).cast(MONEY))
    one = lambda when: F.when(when, 1).otherwise(0).cast("bigint")
    return {"base": amount(t == "BASE_CONTRACT"), "approved": amount(t == "APPROVED_VO"), "approved_or_sent": amount(t.isin("APPROVED_VO", "SENT_VO")), "pending": amount(t == "PENDING_VO"), "n_rows": one(F.lit(True)), "n_evidence": one(has_evidence())}


def kpis(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """One row a project, also without ledger rows. The ledger is summed before the join."""
    t = F.col("type")
    sums = rows.groupBy("project_id").agg(
        money_sum(net_or_product(), t == "BASE_CONTRACT").alias("base"), money_sum(net_or_product(), t == "APPROVED_VO").alias("approved"),
        money_sum(net_or_product(), t.isin("APPROVED_VO", "SENT_VO")).alias("approved_or_sent"), money_sum(net_or_product(), t == "PENDING_VO").alias("pending"),
        F.count("*").alias("n_rows"), F.count_if(has_evidence()).alias("n_evidence"),
    )
    return kpis_of(sums, projects)


def kpis_of(sums: DataFrame, projects: DataFrame) -> DataFrame:
    """KPIs of sums that were made before, one row a project that has any."""
    amounts, counts = KPI_AMOUNTS, KPI_COUNTS
    all_ = projects.select(F.col("id").alias("project_id"), "name", "budget").join(sums, "project_id", "left")
    all_ = all_.withColumns({c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in amounts} | {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
    effective = number_or(F.col("budget").cast(MONEY), F.col("base"))
    progress = F.when(has_number(F.col("effective_budget")), F.least(F.lit(100.0), F.col("approved_or_sent").cast("double") / F.col("effective_budget").cast("double") * 100)).otherwise(0.0)
    out = all_.withColumn("effective_budget", effective).withColumn("coverage_percent", percent(F.col("n_evidence"), F.col("n_rows")))
    return out.withColumn("projected", (F.col("effective_budget") + F.col("approved_or_sent") + F.col("pending")).cast(MONEY)).withColumn("progress_percent", F.round(progress, 6))


def chargeable(item_type: Column) -> Column:
    """Plain items and rows without a type carry money; chapters and notes don't."""
    return ~has_text(item_type) | (item_type == "ITEM")


def line_totals(rows: DataFrame, *keys: str, rate: str = VAT_RATE) -> DataFrame:
    """Subtotal, VAT and total of chargeable rows."""
    subtotal = money_sum(F.col("quantity") * F.col("unit_price_excl_vat"), chargeable(F.col("item_type")))
    out = rows.groupBy(*keys).agg(F.count_if(chargeable(F.col("item_type"))).alias("n_items"), subtotal.alias("subtotal"))
    vat = (F.col("subtotal") * F.lit(rate).cast("decimal(5,4)")).cast(MONEY)
    return out.withColumn("vat", vat).withColumn("total", (F.col("subtotal") + F.col("vat")).cast(MONEY))


def selected_totals(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Sums over rows whose key is among the chosen ones, whatever their type."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_rows"), money_sum("total_price_excl_vat").alias("net"), money_sum("total_price_incl_vat").alias("gross"))


def estimates(rows: DataFrame, rate: str = VAT_RATE) -> DataFrame:
    """rows (quantity, price, markup_percent) with the marked-up net, VAT and total. Markup is no part of the stored amounts."""
    exact = (F.col("quantity") * F.col("price")).cast("decimal(20,4)") * (100 + F.col("markup_percent")).cast("decimal(7,2)") * F.lit("0.01").cast("decimal(3,2)")
    net = exact.cast(MONEY)
    out = rows.withColumn("net", net).withColumn("vat", (F.col("net") * F.lit(rate).cast("decimal(5,4)")).cast(MONEY))
    return out.withColumn("total", (F.col("net") + F.col("vat")).cast(MONEY))


def estimate_defaults(suggested: DataFrame) -> DataFrame:
    """A model's suggestion (description, unit, quantity, price, markup_percent, item_code) with defaults, and the source it speaks for."""
    n = lambda c, kind, default: number_or(F.col(c), F.lit(default)).cast(kind).alias(c)
    source = F.when(F.col("item_code") == "NEW", "CUSTOM_ANALYSIS").otherwise("BOQ")
    rest = [c for c in suggested.columns if c not in ("unit", "quantity", "price", "markup_percent")]
    return suggested.select(*rest, text_or(F.col("unit"), F.lit(AREA_UNIT)).alias("unit"), n("quantity", "decimal(12,2)", 1), n("price", "decimal(15,2)", 0), n("markup_percent", "int", DEFAULT_MARKUP_PERCENT), source.alias("source"))


def approve(estimates: DataFrame, findings: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows with amounts and their project's name, findings of which those with an estimate are marked as estimated)."""
    value = {"type": text_or(F.col("type"), F.lit("PENDING_VO")), "source": text_or(F.col("source"), F.lit("CUSTOM_ANALYSIS")), "item_code": text_or(F.col("item_code"), F.lit("")), "markup_percentage": F.coalesce("markup_percentage", F.lit(0)).cast("decimal(5,4)"), "vat_rate": F.lit(VAT_RATE).cast("decimal(5,4)")}
    rows = with_parent(with_amounts(estimates.withColumns(value)), projects, "project_id", {"name": "project_name"})
    return rows, update_keys(findings, estimates.filter("contradiction_id is not null").select(F.col("contradiction_id").alias("id")), "id", {"pricing_status": F.lit("ESTIMATED")})


def short_totals(rows: DataFrame, *keys: str, rate: str = VAT_RATE) -> DataFrame:
    """Subtotal of stored nets, else of products, VAT on it and the total."""
    out = rows.groupBy(*keys).agg(money_sum(net_or_product()).alias("subtotal")).withColumn("vat", (F.col("subtotal") * F.lit(rate).cast("decimal(5,4)")).cast(MONEY))
    return out.withColumn("total", (F.col("subtotal") + F.col("vat")).cast(MONEY))


def approve_orders(ledger: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """ledger with the chosen pending orders approved."""
    return update_keys(ledger, chosen, key, {"type": F.when(F.col("type") == "PENDING_VO", "APPROVED_VO").otherwise(F.col("type"))})
