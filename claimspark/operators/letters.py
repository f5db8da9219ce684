"""Letters and exports: flattened rows, notes, headers with ordered links, and the ledger's CSV."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions import fixed as X
from claimspark.functions.scalars import has_text, lookup, once, shekels, text_or

from claimspark.sources.shared import kept

from .carry import MOST, placed
from .ledger import MONEY, money_sum, net_or_product

ROW = ["total", "price", "quantity", "unit", "text", "code", "no"]


def notes_text(notes: Column, separator: str = " | ") -> Column:
    """Text of governing notes: plain text as it is; of a JSON list each `text` or the element itself; of a JSON object its instruction or note, else itself."""
    opens = F.substring(F.ltrim(notes), 1, 1)
    texts = F.transform(F.from_json(notes, "array<string>"), lambda n: F.when(F.ltrim(n).startswith("{"), once(F.get_json_object(n, "$.text"), lambda t: text_or(t, n))).otherwise(n))
    of_object = once(F.from_json(notes, "instruction string, note string"), lambda j: text_or(j["instruction"], j["note"], notes))
    return F.when(opens == "[", F.coalesce(F.array_join(texts, separator), notes)).when(opens == "{", of_object).otherwise(notes)


def letter_rows(items: DataFrame, letter: str, order: list[str]) -> DataFrame:
    """One to three rows an item: the item, heading or note itself, then its rationale and its notes. `no` counts all items of the letter."""
    place = F.row_number().over(Window.partitionBy(letter).orderBy(*order))
    kind, e = F.col("item_type"), F.lit("")
    row = lambda *cs: F.struct(*[c.cast("string").alias(n) for n, c in zip(ROW, cs, strict=True)])
    heading = row(e, e, e, e, F.col("description"), text_or(F.col("item_code"), F.when(kind == "CHAPTER", X.CHAPTER_TEXT).otherwise(X.SUBCHAPTER_TEXT)), e)
    note = row(e, e, e, e, F.concat(F.lit("ⓘ "), F.col("description")), F.lit(X.NOTE_TEXT), e)
    item = row(shekels((F.col("quantity") * F.col("unit_price_excl_vat")).cast(MONEY)), shekels(F.col("unit_price_excl_vat")), F.col("quantity"), F.col("unit"), F.col("description"), text_or(F.col("item_code"), F.lit("-")), F.col("_place"))
    said = lambda prefix, c: F.when(has_text(c), row(e, e, e, e, F.concat(F.lit(prefix), c), e, e))
    plain = ~kind.isin("CHAPTER", "SUBCHAPTER", "NOTE") | kind.isNull()
    first = F.when(kind.isin("CHAPTER", "SUBCHAPTER"), heading).when(kind == "NOTE", note).otherwise(item)
    rows = F.array(first, F.when(plain, said(X.RATIONALE_PREFIX, F.col("ai_rationale"))), F.when(plain, said(X.EVIDENCE_PREFIX, F.col("_notes"))))
    out = items.withColumn("_place", place).withColumn("_notes", notes_text(F.col("governing_notes"))).select(letter, "_place", F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("part", "r"))
    return out.select(letter, F.col("_place").cast("bigint").alias("place"), F.col("part").cast("bigint").alias("part"), "r.*")


def letters(items: DataFrame, letter: str, order: list[str], key: list[str], sent: str = "SENT_VO") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers with totals and numbers, links with sort_order from 0, items with their type moved on) - the three tables that a letter writes."""
    headers = items.groupBy(letter).agg(F.count("*").alias("n_items"), money_sum("total_price_excl_vat").alias("total_amount_excl_vat"), money_sum("vat_amount").alias("vat_amount"), money_sum("total_price_incl_vat").alias("total_amount_incl_vat"))
    headers = headers.withColumn("letter_number", F.concat(F.lit("VO-"), F.col(letter).cast("string"))).withColumn("status", F.lit("SENT"))
    order_no = (F.row_number().over(Window.partitionBy(letter).orderBy(*order)) - 1).cast("bigint")
    return headers, items.select(letter, *key, order_no.alias("sort_order")), items.withColumn("type", F.lit(sent))


def note_lines(notes: Column) -> Column:
    """A JSON object's entries as 'label: value', known keys translated."""
    entries = F.map_entries(F.from_json(notes, "map<string,string>"))
    return F.transform(entries, lambda kv: F.concat(lookup(kv["key"], X.NOTE_KEYS, kv["key"]), F.lit(": "), F.coalesce(kv["value"], F.lit(""))))


def evidence_lines(evidence: Column) -> Column:
    """Lines of a JSON list of (document_title, page); of anything else the default."""
    rows = F.from_json(evidence, "array<struct<document_title:string,page:string>>")
    lines = F.transform(rows, lambda r: F.concat(F.lit("- "), text_or(r["document_title"], F.lit(X.EVIDENCE_DOCUMENT)), F.lit(" (עמ' "), text_or(r["page"], F.lit("?")), F.lit(")")))
    return F.when(F.ltrim(evidence).startswith("["), F.array_join(lines, "\n")).otherwise(X.NO_EVIDENCE)


def marked_parts(text: Column) -> Column:
    """text cut before and behind the markers [1] and [2], which stay as parts."""
    return F.filter(F.split(F.regexp_replace(text, r"(\[[12]\])", "\u0001$1\u0001"), "\u0001", -1), lambda x: x != "")


def export_rows(ledger: DataFrame, project: str = "project_id", tie: list[str] = ["letter_id", "line_no", "item_id"], most: int = MOST, complete: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:  # noqa: B006
    """Ten text columns c1 to c10 of each project's export, ordered by (section, place): details by creation, a blank row, five totals.

    The ledger's rows are made once, as a table of their own columns, and shuffled once, by their project: there each gets its place and its project's sums, and the last one of a project brings the rows
    behind it. With `complete`, ledger has only what a row can't do without, and complete(rows) adds the columns that follow from these when they are needed.
    """
    e, text = F.lit(""), lambda c: c.cast("string")
    amount = lambda c: text(F.coalesce(F.col(c), F.lit(0)))
    amounts = ["quantity", "unit_price_excl_vat", "total_price_excl_vat", "markup_percentage", "vat_amount", "total_price_incl_vat"]
    cells = [lookup(F.col("type"), X.EXPORT_LABELS, F.col("type")), text_or(text(F.col("item_code")), e), text_or(F.col("description"), e), text_or(F.col("unit"), e)] + [amount(c) for c in amounts]
    needed = list(dict.fromkeys([project, "created_at", *tie, "type", "item_code", "description", "unit", *amounts]))
    base = F.col("type") == "BASE_CONTRACT"
    net = F.col("total_price_excl_vat")
    sums = {"_a": F.sum(F.when(base, net)), "_b": F.sum(F.when(~base, net)), "_c": F.sum(net), "_d": F.sum("vat_amount"), "_e": F.sum("total_price_incl_vat")}
    rows = kept(ledger if complete else ledger.select(*needed))
    own = (lambda r: complete(r).select(*needed)) if complete else (lambda r: r)
    all_placed = placed(rows, [project], [F.asc_nulls_last("created_at"), *[F.asc_nulls_first(c) for c in tie]], kept, "place", {"_n": F.count("*")} | sums, most, own)
    # line 0 is the row itself, 1 the blank row, from 2 on the totals
    lines = all_placed.withColumn("_line", F.explode(F.when(F.col("place") == F.col("_n"), F.sequence(F.lit(0), F.lit(6))).otherwise(F.array(F.lit(0)))))
    line, at = F.col("_line"), {"_a": 7, "_b": 7, "_c": 7, "_d": 9, "_e": 10}
    total = lambda i: F.coalesce(*[F.when(line == k, text(F.coalesce(F.col(s), F.lit(0)).cast(MONEY))) for k, s in enumerate(at, 2) if at[s] == i], e) if i in at.values() else e
    ends = [F.coalesce(*[F.when(line == k, label) for k, label in enumerate(X.EXPORT_TOTALS, 2)], e)] + [total(i) for i in range(2, 11)]
    return lines.select(project, F.when(line == 0, 0).otherwise(1).alias("section"), F.when(line == 0, F.col("place")).otherwise((line - 1).cast("bigint")).alias("place"), *[F.when(line == 0, c).otherwise(end).alias(f"c{i}") for i, (c, end) in enumerate(zip(cells, ends, strict=True), 1)])


def csv_lines(rows: DataFrame, strict: bool = False) -> DataFrame:
    """rows of export_rows as one text line each. Only the description of a detail row is quoted; `strict` quotes whatever needs it."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.col(f"c{i}") for i in range(1, 11)]
    if strict:
        cells = [F.when(c.rlike('[",\n\r]'), quoted(c)).otherwise(c) for c in cells]
    else:
        cells[2] = F.when(F.col("section") == 0, quoted(cells[2])).otherwise(cells[2])
    some = [F.coalesce(c, F.lit("")) for c in cells]  # else a null would move the cells behind it
    return rows.select(*[c for c in rows.columns if not c.startswith("c")], F.concat_ws(",", *some).alias("line"))


def short_csv_lines(ledger: DataFrame, key: str, order: list[str], rate: str = X.VAT_RATE) -> DataFrame:
    """(key, section, place, line) of the short export: headers, a line of six cells a row in order, a blank line, and subtotal, VAT on it and total."""
    e, text = F.lit(""), lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    net = net_or_product().cast(MONEY)
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("description", e), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [text_or(F.col("item_code").cast("string"), e), quoted, text_or(F.col("unit"), e), text(F.col("quantity")), text(F.col("unit_price_excl_vat")), text(net)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    detail = ledger.select(key, F.lit(1).alias("section"), place.alias("place"), F.concat_ws(",", *cells).alias("line"))
    sums = ledger.groupBy(key).agg(money_sum(net).alias("n")).withColumn("v", (F.col("n") * F.lit(rate).cast("decimal(5,4)")).cast(MONEY))
    total = lambda label, c: F.concat(F.lit(f",,,,{label},"), c.cast("string"))
    percent = int(Decimal(rate) * 100)
    ends = F.array(e, *[total(label.format(percent), c) for label, c in zip(X.SHORT_TOTALS, (F.col("n"), F.col("v"), (F.col("n") + F.col("v")).cast(MONEY)), strict=True)])
    frame = [(0, F.array(F.lit("\ufeff" + ",".join(X.SHORT_HEADERS)))), (2, ends)]
    around = [sums.select(key, F.lit(section).alias("section"), F.posexplode(lines).alias("place", "line")).withColumn("place", F.col("place").cast("bigint")) for section, lines in frame]
    return detail.unionByName(around[0]).unionByName(around[1])


def appendix(items: DataFrame, letter: str, order: list[str]) -> DataFrame:
    """One row a source of the items with notes or a rationale: their number in the letter, heading, source text and rationale, with words for what is missing."""
    some = items.filter(has_text(F.col("governing_notes")) | has_text(F.col("ai_rationale")))
    some = some.withColumn("_number", F.row_number().over(Window.partitionBy(letter).orderBy(*order)).cast("bigint"))
    code = F.when(has_text(F.col("item_code")), F.concat(F.lit("["), F.col("item_code"), F.lit("] "))).otherwise("")
    notes = F.col("governing_notes")
    listed = F.when(F.ltrim(notes).startswith("["), F.from_json(notes, "array<string>"))
    sources = F.coalesce(listed, F.array(text_or(notes, F.lit(X.NO_SOURCES))))
    rows = some.select(letter, F.col("_number").alias("number"), F.concat(code, F.coalesce("description", F.lit(""))).alias("heading"), text_or(F.col("ai_rationale"), F.lit(X.DEFAULT_RATIONALE)).alias("rationale"), F.posexplode_outer(sources).alias("source_no", "source"))
    return rows.withColumn("source_no", F.col("source_no").cast("bigint"))


def evidence_summary(items: DataFrame, letter: str, shown: int = 3) -> DataFrame:
    """Per letter: whether any or none of its items has evidence, how many have, and how many of those aren't shown."""
    there = has_text(F.col("governing_notes")) | has_text(F.col("ai_rationale"))
    n = F.count_if(there)
    return items.groupBy(letter).agg(F.bool_or(there).alias("any_evidence"), F.bool_and(~there).alias("no_evidence"), n.alias("n_evidence"), F.greatest(n - shown, F.lit(0)).cast("bigint").alias("n_more"))


def letter_items(ledger: DataFrame, chosen: DataFrame, key: str, stored: bool = True) -> DataFrame:
    """The chosen ledger rows as a letter's items; the total is the stored net, or quantity times price."""
    total = F.col("total_price_excl_vat") if stored else (F.col("quantity") * F.col("unit_price_excl_vat"))
    return ledger.join(chosen.select(key).distinct(), key, "left_semi").select(key, "description", "unit", "quantity", F.col("unit_price_excl_vat").alias("unit_price"), F.coalesce(total, F.lit(0)).cast(MONEY).alias("total"))


def instruction(name: Column, texts: dict[str, str], default: str = X.DEFAULT_TONE) -> Column:
    """The text that a tone or kind of letter stands for; the caller's table."""
    return lookup(name, texts, F.lit(default))


def history(turns: DataFrame, key: str, order: str) -> DataFrame:
    """All but each conversation's last turn, with the roles user and model. Only the last places are shuffled, not the turns."""
    last = turns.groupBy(key).agg(F.max(order).alias("_last"))
    role = F.when(F.col("role") == "user", "user").otherwise("model")
    return turns.join(last, key).filter(F.col(order) < F.col("_last")).drop("_last").withColumn("role", role)
