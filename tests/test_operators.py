"""Operators on literal rows."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from claimspark.functions import fixed, scalars as S
from claimspark.operators import changes, documents, findings, hierarchy, ledger, letters, pricelist, search, security
from claimspark.sources import files


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_amounts_are_rounded_once(spark):
    rows = [("1.11", "2.25"), ("0.01", "0.50"), ("3.00", "33.33"), ("0.15", "0.17")]
    df = spark.createDataFrame(rows, "q string, p string").select(F.col("q").cast("decimal(12,2)").alias("quantity"), F.col("p").cast("decimal(15,2)").alias("unit_price_excl_vat"), F.lit("0.18").cast("decimal(5,4)").alias("vat_rate"))
    got = [tuple(map(str, r)) for r in ledger.with_amounts(df).select("total_price_excl_vat", "vat_amount", "total_price_incl_vat").collect()]
    assert got == [("2.50", "0.45", "2.95"), ("0.01", "0.00", "0.01"), ("99.99", "18.00", "117.99"), ("0.03", "0.00", "0.03")]


@pytest.mark.parametrize(("text", "value"), [("12.5abc", 12.5), (" 7", 7.0), ("abc", 0.0), (None, 0.0), (".5", 0.5), ("-2e1x", -20.0)])
def test_parse_float(spark, text, value):
    assert one(spark, S.parse_float(F.lit(text).cast("string"))) == value


def test_scalars(spark):
    r = spark.range(1).select(S.round_half_up(F.lit(2.5)).alias("a"), S.round_half_up(F.lit(-2.5)).alias("b"), S.has_text(F.lit("[]")).alias("c"), S.has_text(F.lit("")).alias("d"), S.has_number(F.lit(0)).alias("e"), S.pad2(F.lit(123)).alias("f"), S.extension(F.lit("a.b.PDF")).alias("g"), S.outer_array(F.lit("x [1,\n[2]] y")).alias("h"), S.without_attribution(F.lit("Powered by x"), fixed.ATTRIBUTIONS).alias("i"), S.segments(F.lit("95...")).alias("j"), ledger.percent(F.lit(1), F.lit(3)).alias("k"), ledger.percent(F.lit(0), F.lit(0)).alias("l")).first()
    assert tuple(r) == (3, -2, True, False, False, "123", "pdf", "[1,\n[2]]", "Powered by x", ["95", "", "", ""], 33, 0)


def test_truth_falls_back(spark):
    rows = spark.createDataFrame([(D("0.00"),), (None,), (D("7.00"),)], "total_price_excl_vat decimal(15,2)").withColumn("quantity", F.lit(2).cast("decimal(12,2)")).withColumn("unit_price_excl_vat", F.lit(5).cast("decimal(15,2)"))
    assert [int(r[0]) for r in rows.select(ledger.net_or_product()).collect()] == [10, 10, 7]


LONG, SHORT = "a description that is long", "short"


@pytest.mark.parametrize(
    ("code", "text", "unit", "rate", "types"),
    [
        ("95...", SHORT, "", 0, ("CHAPTER", "CHAPTER", "CHAPTER")), ("95.01..", SHORT, "", 0, ("SUBCHAPTER", "CHAPTER", "SUBCHAPTER")), ("95.01.01.", SHORT, "", 0, ("SUBCHAPTER", "SUBCHAPTER", "SUBCHAPTER")),
        ("95.01.01.0001", LONG, "set", 6.8, ("ITEM", "ITEM", "ITEM")), ("95.02..", LONG, "", 0, ("SUBCHAPTER", "CHAPTER", "NOTE")), ("95.01.00.0001", SHORT, "", 0, ("ITEM", "ITEM", "NOTE")),
        ("95.01.01.0002", "x לרבות", "set", 10, ("ITEM", "ITEM", "NOTE")), ("96...", "x לרבות", "", 0, ("CHAPTER", "CHAPTER", "CHAPTER")), ("", SHORT, "", 0, ("ITEM", "ITEM", "ITEM")),
    ],
)
def test_item_types(spark, code, text, unit, rate, types):
    r = pricelist.classified(spark.createDataFrame([(code, text, unit, float(rate))], "item_code string, description string, unit string, rate double")).first()
    assert (r["loader_type"], r["repair_type"], r["item_type"]) == types


def test_nearest_notes_with_short_prefixes(spark):
    rows = [(1, "95...", "CHAPTER"), (2, "95", "NOTE"), (3, "95.01.00.0001", "NOTE"), (4, "95.01.01.0001", "ITEM"), (5, "95.02.01.0001", "ITEM"), (6, "95.02.01.0002", "NOTE"), (7, "95.02.01.0003", "ITEM"), (8, "96.0", "NOTE"), (9, "96.01.01.0001", "ITEM")]
    items = spark.createDataFrame([(i, c, t, "l", i) for i, c, t in rows], "id bigint, item_code string, item_type string, pricelist_id string, pos bigint")
    assert {r["id"]: r["note_id"] for r in hierarchy.governing_notes(items).collect()} == {4: 3, 5: 2, 7: 6, 9: 8}
    assert {r["id"]: r["note_id"] for r in hierarchy.governing_notes_by_prefix(items).collect()} == {4: 3, 5: None, 7: 6, 9: None}


def test_parent_prefixes_and_boundaries(spark):
    items = spark.createDataFrame([(1, "95.1.01.0001")], "id bigint, item_code string")
    p = hierarchy.parent_prefixes(items)
    assert {r["prefix"] for r in p.collect()} == {"95", "95.1", "95.1.01"}
    notes = spark.createDataFrame([(1, "95.10"), (2, "96.1"), (3, "9")], "id bigint, item_code string")
    only = p.filter("prefix <> '95'")
    assert [r["id"] for r in hierarchy.notes_under(notes, only).collect()] == [1]
    assert hierarchy.notes_under(notes, only, boundary="segment").count() == 0


def test_severity_and_order(spark):
    f = spark.createDataFrame([(1, "סתירה"), (2, "שינוי"), (3, "שינוי סתירה"), (4, None)], "id bigint, category string").withColumn("severity", findings.severity(F.col("category"))).withColumn("created_at", F.lit(1))
    assert [r["severity"] for r in f.orderBy("id").collect()] == ["HIGH", "MEDIUM", "HIGH", "LOW"]
    assert [r["severity"] for r in f.orderBy(*findings.by_severity(f)).collect()] == ["LOW", "MEDIUM", "HIGH", "HIGH"]
    assert f.orderBy(*findings.by_severity(f, most_severe_first=True)).first()["severity"] == "HIGH"


def test_changes(spark):
    a, b = (spark.createDataFrame(r, "id bigint, x string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "d")]))
    assert sorted(map(tuple, changes.union_first(a, b.distinct(), "id").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, changes.insert_missing(a, b, "id").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, changes.update_keys(a, b, "id", {"x": F.lit("z")}).collect())) == [(1, "a"), (2, "z")]
    assert [r["id"] for r in changes.delete_keys(a, b, "id").collect()] == [1]
    nulls = spark.createDataFrame([(1, None)], "id bigint, x string")
    assert changes.delete_where(nulls, F.col("x") == "a").count() == 1
    assert changes.set_null(a.select("x", "id"), "id", b).orderBy("x").collect()[1]["id"] is None


def test_vat_repair_keeps_other_rates(spark):
    df = spark.createDataFrame([("0.17",), ("0.10",)], "r string").select(F.lit(1).cast("decimal(12,2)").alias("quantity"), F.lit(100).cast("decimal(15,2)").alias("unit_price_excl_vat"), F.col("r").cast("decimal(5,4)").alias("vat_rate"))
    assert [int(r["vat_amount"]) for r in ledger.repair_vat(df, "0.17").collect()] == [18, 10]


def test_best_source_and_no_match(spark):
    f = spark.createDataFrame([(1,), (2,)], "id bigint")
    c = spark.createDataFrame([(1, "DEKEL", D("1.00"), "d"), (1, "BOQ", D("9.00"), "b")], "id bigint, source string, price decimal(15,2), item_code string")
    got = {r["id"]: (r["match_found"], r["source"], int(r["price"])) for r in search.best_source(f, c, "id").collect()}
    assert got == {1: (True, "BOQ", 9), 2: (False, "CUSTOM_ANALYSIS", 0)}
    assert search.best_source(f, c, "id", override="DEKEL").filter("id = 1").first()["source"] == "DEKEL"


def test_visibility(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id bigint, project_id bigint")
    projects = spark.createDataFrame([(10, "u"), (20, "v")], "id bigint, contractor_id string")
    assert [r["id"] for r in security.visible(rows, projects, "u").collect()] == [1]
    assert security.visible(rows, projects, "u", admin=True).count() == 3


def test_letter_rows(spark):
    schema = "letter_id bigint, n int, item_type string, item_code string, description string, unit string, quantity decimal(12,2), unit_price_excl_vat decimal(15,2), ai_rationale string, governing_notes string"
    rows = [(1, 1, "CHAPTER", None, "head", None, None, None, "no", None), (1, 2, "NOTE", "1", "note", None, None, None, None, None), (1, 3, None, None, "it", "m", D("2"), D("1500"), "why", '[{"text":"t"},{"a":1}]')]
    got = letters.letter_rows(spark.createDataFrame(rows, schema), "letter_id", ["n"]).orderBy("place", "part").collect()
    assert [r["text"] for r in got] == ["head", "ⓘ note", "it", fixed.RATIONALE_PREFIX + "why", fixed.EVIDENCE_PREFIX + 't | {"a":1}']
    assert (got[0]["code"], got[2]["code"], got[2]["total"], got[2]["no"]) == (fixed.CHAPTER_TEXT, "-", "₪3,000.00", "3")


def test_strict_csv_quotes_any_cell(spark):
    row = spark.createDataFrame([(0, *["a,b", "c", 'd"e'], *["x"] * 7)], "section int, " + ", ".join(f"c{i} string" for i in range(1, 11)))
    assert letters.csv_lines(row, strict=True).first()["line"] == '"a,b",c,"d""e",x,x,x,x,x,x,x'
    assert letters.csv_lines(row).first()["line"] == 'a,b,c,"d""e",x,x,x,x,x,x,x'


def test_document_parsing(spark):
    d = spark.createDataFrame([(1, '{"full_markdown":"m","financial_data":{"items":[{"code":"1","quantity":2.0}]},"warnings":[]}'), (2, "not json"), (3, None)], "id bigint, parsed_json string")
    c = documents.content(d)
    assert {r["id"]: (r["is_document"], r["has_items"], r["has_warnings"]) for r in c.collect()} == {1: (True, True, False), 2: (False, False, False), 3: (False, False, False)}
    assert documents.content_items(c).count() == 1 and documents.content_warnings(c).count() == 0
    assert one(spark, documents.storage_path(F.lit("https://h/documents/a/b.pdf"))) == "a/b.pdf"


def test_bill_of_quantities_gets_defaults(spark):
    answer = '```json\n{"project_name":"p","items":[{"item_code":"1","quantity":2,"unit_price_excl_vat":3.5},{"description":"d"}]}\n```'
    rows = pricelist.items_of_model(spark.createDataFrame([(1, answer), (2, "sorry")], "id bigint, response string")).collect()
    assert [(r["id"], r["item_code"], r["item_type"], float(r["rate"])) for r in rows] == [(1, "1", "ITEM", 3.5), (1, "", "ITEM", 0.0)]


def test_merge_strategy_overwrites_with_null(spark):
    merged = one(spark, F.concat_ws("|", findings.merge_strategy(F.lit('{"a":1,"expert_strategy":{"x":2}}'), F.lit(None).cast("string")), findings.merge_strategy(F.lit(None).cast("string"), F.lit('{"y":1}'))))
    assert merged == '{"a":1,"expert_strategy":null}|{"expert_strategy":{"y":1}}'


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"x")
    (tmp_path / "in" / "b.jpeg").write_bytes(b"yy")
    (tmp_path / "in" / "c.exe").write_bytes(b"z")
    docs = files.with_model(files.read_documents(spark, str(tmp_path / "in")), lambda mime, content: f"{mime} {len(content)}")
    assert {r["name"]: (r["kind"], r["response"]) for r in docs.collect()} == {"a.PDF": ("pdf", "application/pdf 4"), "b.jpeg": ("image", "image/jpeg 4")}  # c.exe is turned away
    sheet = tmp_path / "s.csv"
    sheet.write_text('h1,h2,h3,h4,h5,h6,h7\nA,95...,"two\nlines",1,2 m, u ,n/a\nlone,,,,,,\n', encoding="utf-8")
    rows = pricelist.typed_rows(pricelist.filled_rows(files.read_sheet(spark, str(sheet)))).collect()
    assert [(r["item_code"], r["description"], float(r["quantity"]), r["unit"], float(r["rate"])) for r in rows] == [("95...", "two\nlines", 2.0, "u", 0.0)]
    lines = spark.createDataFrame([(5, 1, 0, "total"), (5, 0, 2, "b"), (5, 0, 1, "a"), (6, 0, 1, "other")], "project_id int, section int, place bigint, line string")
    files.write_export(lines, str(tmp_path / "out"), 5)
    [part] = (tmp_path / "out").glob("part-*")
    text = part.read_text(encoding="utf-8")
    assert text == "﻿" + ",".join(fixed.EXPORT_HEADERS) + "\na\nb\ntotal\n"
    files.write_export(lines, str(tmp_path / "parts"), 5, files=3)
    assert "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "parts").glob("part-*"))) == text
    for _ in range(2):
        files.append(lines, str(tmp_path / "table"), ["project_id"])
    assert spark.read.parquet(str(tmp_path / "table")).count() == 8


def test_workbooks_sheets_and_heads(spark, tmp_path):
    import json
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "books").mkdir()
    with zipfile.ZipFile(tmp_path / "books" / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>95...</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {space}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="inlineStr"><is><t>head</t></is></c></row><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="E2"><v>2.5</v></c></row><row/></sheetData></worksheet>')
    rows = files.read_workbooks(spark, str(tmp_path / "books"))
    assert [tuple(r) for r in rows.orderBy("row_no").collect()] == [(None, "95...", "two runs", None, "2.5", None, None, "a.xlsx", 1), (*[None] * 7, "a.xlsx", 2)]
    typed = pricelist.typed_rows(pricelist.filled_rows(rows, pricelist.SHEET)).collect()
    assert [(r["item_code"], float(r["quantity"])) for r in typed] == [("95...", 2.5)]
    (tmp_path / "s").mkdir()
    for name in ("x", "y"):
        (tmp_path / "s" / f"{name}.csv").write_text("h\na,b\n,,\nc,d\n")
    sheet = files.read_sheet(spark, str(tmp_path / "s" / "x.csv"))
    assert [r["item_code"] for r in files.sheet_head(sheet, 5).collect()] == ["b", "d"]
    assert {r["sheet"]: r["n_rows"] for r in files.sheet_census(spark, str(tmp_path / "s")).collect()} == {"x.csv": 3, "y.csv": 3}
    files.write_head(spark.range(9), str(tmp_path / "head"), 2)
    assert sum(len(p.read_text().split()) for p in (tmp_path / "head").glob("part-*")) == 2 and json.loads(next(p.read_text() for p in (tmp_path / "head").glob("part-*") if p.read_text()).split()[0]) == {"id": 0}


@pytest.mark.parametrize(("force", "document", "left", "scan"), [(False, None, [1, 2, 3, 4], False), (True, None, [4], True), (True, 5, [4], True), (False, 5, [2, 3, 4], True)])
def test_scan_control(spark, force, document, left, scan):
    f = spark.createDataFrame([(1, 7, 5), (2, 7, 6), (3, 7, None), (4, 8, 5)], "id bigint, project_id bigint, source_execution_doc_id bigint")
    kept, again = findings.scan_control(f, 7, force, document)
    assert sorted(r["id"] for r in kept.collect()) == left and again is scan
    assert findings.scan_control(f, 9)[1] is True  # nothing is stored of it


def test_nulls_keep_their_place_in_csv(spark):
    row = spark.createDataFrame([(0, *[None if i in (0, 4) else "x" for i in range(10)])], "section int, " + ", ".join(f"c{i} string" for i in range(1, 11)))
    assert letters.csv_lines(row).first()["line"] == ',x,"x",x,,x,x,x,x,x'


def test_one_row_and_user_rights(spark):
    assert changes.one_row(spark.range(1))["id"] == 0
    for n in (0, 2):
        with pytest.raises(ValueError):
            changes.one_row(spark.range(n))
    people = spark.createDataFrame([("u", "super_admin"), ("v", "user")], "id string, role string")
    assert security.is_admin(people, "u") and not security.is_admin(people, "v") and not security.is_admin(people, "w")
    lists = spark.createDataFrame([(1, True, "v"), (2, False, "u"), (3, False, "v"), (4, None, None)], "id bigint, is_global boolean, contractor_id string")
    assert [r["id"] for r in security.visible_lists(lists, "u").orderBy("id").collect()] == [1, 2] and security.visible_lists(lists, "u", admin=True).count() == 4
    assert [one(spark, S.number(F.lit(x).cast("string"))) for x in ("12", " 3.5 ", "12x", "", None)] == [12.0, 3.5, 0.0, 0.0, 0.0]


def test_answers_without_an_array_give_no_finding(spark):
    answers = spark.createDataFrame([(1, 2, "w", None, None, "sorry"), (1, 3, "w", None, None, 'ok [{"title":"t"}]')], "project_id bigint, work_id bigint, work_title string, contract_id bigint, contract_title string, response string")
    [r] = findings.scanned(answers).collect()
    assert (r["source_execution_doc_id"], r["title"], r["severity"], r["target_contract_doc_id"]) == (3, "t", "LOW", None) and fixed.CONTRACT_TITLE in r["evidence_data"]


def test_positions_are_places_in_the_whole_list(spark):
    rows = [(i, code, key) for i, (code, key) in enumerate((c, k) for k in ("a", "b", None) for c in (None, "", "1", "01.02.01.0003", "01.02.01.0001", "01.02..", "95...", "01.02.01.0001", "9"))]
    items = spark.createDataFrame(rows, "id bigint, item_code string, pricelist_id string")
    expected = {}
    for key in ("a", "b", None):
        for pos, r in enumerate(sorted((r for r in rows if r[2] == key), key=lambda r: (r[1] is not None, r[1] or "", r[0])), 1):
            expected[r[0]] = pos
    for ranges in (None, 1, 2, 7):
        assert {r["id"]: r["pos"] for r in hierarchy.positions(items, ranges=ranges).collect()} == expected


def test_scan_inputs_of_one_document(spark):
    docs = spark.createDataFrame([(1, 7, "c", "CONTRACT", "terms"), (2, 7, "w", "EXECUTION", "work"), (3, 7, "v", "SITE_REPORT", None), (4, 8, "u", "EXECUTION", "alone")], "id bigint, project_id bigint, title string, category string, extracted_text string")
    assert [tuple(r) for r in findings.scan_inputs(docs, 2).collect()] == [(7, 2, "w", "work", 1, "c")]
    assert findings.scan_inputs(docs, 3).count() == 0  # it is there, but has no text
    assert {(r["work_id"], r["contract_id"]) for r in findings.scan_inputs(docs).collect()} == {(2, 1), (4, None)}
    for unknown in (1, 99):
        with pytest.raises(LookupError):
            findings.scan_inputs(docs, unknown)
    assert [tuple(r) for r in findings.whole_contexts(findings.scan_contexts(docs)).collect()] == [(7, "--- Document: c ---\nterms")]
