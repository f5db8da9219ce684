"""Loads with refused rows, rewritten partitions, deletes over the graph of references, workbooks, sinks and state that ends."""

import json
import shutil
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimspark.operators import ledger as L
from claimspark.operators.constraints import Constraints, judged
from claimspark.operators.findings import merge_strategy
from claimspark.operators.references import Reference, deleted, going, in_order
from claimspark.sources import files, stored, views, workbooks
from claimspark.streaming import feeds, sinks

DATA = "/root/testdata/sf0.001"


def rules(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id bigint")
    return Constraints(not_null=("name",), members={"kind": ("A", "B")}, references={"parent": (parents, "id")}, unique=(("code",), ("parent", "name")))


NEW = [(1, "a", "A", 1, "x"), (2, None, "A", 1, "y"), (3, "b", "C", 1, "x"), (4, "c", None, None, "x"), (5, "d", "B", 9, None), (6, "a", "B", 1, "z"), (7, "a", "B", 2, None), (8, "e", "A", 2, "z"), (9, None, "Z", 7, "q")]
SCHEMA = "no bigint, name string, kind string, parent bigint, code string"
REASONS = {1: "", 2: "null:name", 3: "member:kind", 4: "unique:code", 5: "reference:parent", 6: "unique:parent+name", 7: "", 8: "unique:code", 9: "null:name,member:kind,reference:parent"}


def test_rows_are_judged_by_all_constraints(spark):
    new = spark.createDataFrame(NEW, SCHEMA)
    assert {r["no"]: ",".join(r["reasons"]) for r in judged(new, rules(spark), ["no"]).collect()} == REASONS | {8: "unique:code"}
    there = spark.createDataFrame([(90, "q", "A", 1, "x")], SCHEMA)
    got = {r["no"]: ",".join(r["reasons"]) for r in judged(new, rules(spark), ["no"], there).collect()}
    assert got[1] == "unique:code" and got[7] == ""
    by_batch = judged(new.withColumn("batch", F.floor((F.col("no") - 1) / 3)), rules(spark), ["no"], batch="batch")
    assert {r["no"]: ",".join(r["reasons"]) for r in by_batch.collect()} == REASONS | {1: "batch", 7: "batch"}  # rows of a batch go with a broken one
    assert judged(new.limit(0), rules(spark), ["no"]).count() == 0 and judged(new, Constraints(), ["no"]).filter(F.size("reasons") > 0).count() == 0


def test_a_load_runs_twice_with_one_result(spark, tmp_path):
    new, path = spark.createDataFrame(NEW, SCHEMA), str(tmp_path / "t")
    both = lambda: (sorted(r["no"] for r in stored.loaded(spark, path).collect()), sorted((r["no"], ",".join(r["reasons"]), r["load"]) for r in stored.refused(spark, path).collect()))
    for _ in range(2):
        stored.load(new, path, "one", rules(spark), ["no"])
        first = both()
    assert first[0] == [1, 7] and len(first[1]) == 7 and {x for *_, x in first[1]} == {"one"}
    more = spark.createDataFrame([(11, "n", "A", 1, "x"), (12, "n", "A", 2, "w")], SCHEMA)
    for _ in range(2):
        stored.load(more, path, "2", rules(spark), ["no"])
        assert both()[0] == [1, 7, 12] and (11, "unique:code", "2") in both()[1]
    for odd in ("007", "7", "a b:c/d%"):
        stored.load(spark.createDataFrame([(hash(odd) % 1000 + 100, odd, "A", 1, odd)], SCHEMA), path, odd, rules(spark), ["no"])
        stored.load(spark.createDataFrame([(hash(odd) % 1000 + 100, odd, "A", 1, odd)], SCHEMA), path, odd, rules(spark), ["no"])
    assert sorted(r["load"] for r in stored.loaded(spark, path).filter("no >= 100").collect()) == ["007", "7", "a b:c/d%"]
    for odd in ("007", "7", "a b:c/d%"):
        stored.load(new.limit(0), path, odd, rules(spark), ["no"])
    stored.load(new.filter("no = 7"), path, "one", rules(spark), ["no"])  # what an earlier run refused doesn't stay
    assert both() == ([7, 12], [(11, "unique:code", "2")])


def snapshot(path):
    return {p.name: (p.parent.name, p.stat().st_mtime_ns) for p in Path(path).rglob("part-*.parquet")}


def test_updates_rewrite_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(200).select("id", (F.col("id") % 5).cast("int").alias("bucket"), F.concat(F.lit("b:"), (F.col("id") % 2).cast("string")).alias("half"), F.lit("old").alias("note"))
    rows.repartition(2).write.partitionBy("bucket", "half").parquet(path)
    before, held = snapshot(path), {r["id"]: (r["bucket"], r["half"], r["note"]) for r in rows.collect()}
    time.sleep(0.05)
    keys = spark.createDataFrame([(3, "new 3"), (13, "new 13"), (13, "new 13"), (999, "no"), (None, "no")], "id bigint, said string")
    assert stored.update_stored(spark, path, ["bucket", "half"], keys, "id", {"note": F.col("said")}) == 1  # 3 and 13 are both in bucket 3, half 1
    after = snapshot(path)
    gone = {n for n in before if n not in after}
    assert gone == {n for n, (folder, _) in before.items() if n in gone} and all(after[n] == before[n] for n in before if n not in gone) and len(gone) <= 2
    held |= {3: (3, "b:1", "new 3"), 13: (3, "b:1", "new 13")}
    read = lambda: {r["id"]: (r["bucket"], r["half"], r["note"]) for r in spark.read.parquet(path).collect()}
    assert read() == held
    assert stored.delete_stored(spark, path, ["bucket", "half"], spark.range(0, 200, 10), "id") == 1  # all of bucket 0, half 0
    held = {k: v for k, v in held.items() if k % 10}
    assert read() == held and not (tmp_path / "ledger" / "bucket=0" / "half=b%3A0").exists() and not list((tmp_path / "ledger").glob("_rewrite*"))
    strategy = spark.createDataFrame([(11, '{"risk":"low"}')], "id bigint, advice string")
    assert stored.update_stored(spark, path, ["bucket", "half"], strategy, "id", {"note": merge_strategy(F.lit('{"a":1}'), F.col("advice"))}) == 1  # a merge of JSON is an update like any other
    held[11] = (1, "b:1", '{"a":1,"expert_strategy":{"risk":"low"}}')
    assert stored.update_stored_where(spark, path, ["bucket", "half"], F.col("note").like("new%"), {"note": F.lit("done")}) == 1
    assert stored.delete_stored_where(spark, path, ["bucket", "half"], F.col("bucket") == 4) == 2
    assert read() == {k: (b, h, "done" if n.startswith("new") else n) for k, (b, h, n) in held.items() if b != 4}
    assert stored.delete_stored(spark, path, ["bucket", "half"], spark.range(1000, 1001), "id") == 0
    with pytest.raises(ValueError):
        stored.update_stored(spark, path, ["bucket", "half"], keys, "id", {"bucket": F.lit(1)})


GRAPH = [Reference("b", "a_id", "a"), Reference("c", "b_id", "b"), Reference("d", "c_id", "c"), Reference("d", "a_id", "a", cascade=False), Reference("c", "twin", "c", cascade=False), Reference("c", "a_code", "a", "code")]


def test_deletes_walk_the_graph_of_references(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "d": make([(1, 1, 1), (2, 2, 2), (3, 3, 1), (4, None, 1), (5, 4, None)], "id bigint, c_id bigint, a_id bigint"),
        "a": make([(1, "p"), (2, "q"), (3, None)], "id bigint, code string"),
        "b": make([(1, 1), (2, 2), (3, None)], "id bigint, a_id bigint"),
        "c": make([(1, 1, 2, None), (2, 2, 1, "q"), (3, 3, 4, "q"), (4, 3, 4, "p")], "id bigint, b_id bigint, twin bigint, a_code string"),
        "other": make([(7,)], "id bigint"),
    }
    assert [t for t in in_order(GRAPH) if t in "abcd"] == ["a", "b", "c", "d"]
    after = {k: sorted(map(tuple, v.collect()), key=str) for k, v in deleted(tables, GRAPH, {"a": tables["a"].filter("id = 1")}).items()}
    assert after["a"] == sorted([(2, "q"), (3, None)], key=str) and after["b"] == [(2, 2), (3, None)] and after["other"] == [(7,)]
    assert after["c"] == [(2, 2, None, "q"), (3, 3, None, "q")]  # 1 went with its b, 4 with the code; both were twins
    assert after["d"] == [(2, 2, 2), (3, 3, None), (4, None, None)]
    assert set(going(tables, GRAPH, {"b": tables["b"].filter("id = 3")})) == {"b", "c"}
    with pytest.raises(ValueError, match="circle"):
        in_order([Reference("x", "y_id", "y"), Reference("y", "x_id", "x")])
    in_order([Reference("x", "y_id", "y"), Reference("y", "x_id", "x", cascade=False)])


def book(path, order, sheets):
    """A workbook whose list names files in another order than their numbers."""
    main, rel = workbooks.MAIN[1:-1], workbooks.LINKED[1:-1]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="x{f}"{s}/>' for i, (n, f, s) in enumerate(order)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="x{f}" Target="{"/xl/" if f == 2 else ""}worksheets/sheet{f}.xml"/>' for _, f, _ in order) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>rich </t></r><r><t>text</t></r><rPh sb="0" eb="1"><t>HINT</t></rPh></si></sst>')
        for f, body in sheets.items():
            z.writestr(f"xl/worksheets/sheet{f}.xml", f'<worksheet xmlns="{main}">{body}</worksheet>')


def test_workbooks_by_their_own_list(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    book(tmp_path / "a.xlsx", [("first", 3, ""), ("hidden one", 1, ' state="hidden"'), ("last", 2, ""), ("lost", 9, "")], {
        1: '<dimension ref="B2:C9"/><sheetData/>',
        2: "<sheetData/>",
        3: f'<dimension ref="A1:AB7"/><sheetData><row r="1">{cell("A1", "head")}</row><row r="3"><c r="B3" t="s"><v>0</v></c>{cell("E3", "2.5")}{cell("AB3", "far")}</row><row>{cell("C4", "no number")}</row></sheetData>',
    })
    shutil.copy(tmp_path / "a.xlsx", tmp_path / "~$a.xlsx")
    census = [tuple(r) for r in workbooks.census(spark, str(tmp_path)).orderBy("position").collect()]
    assert census == [("a.xlsx", "first", 0, "visible", "A1:AB7", 7), ("a.xlsx", "hidden one", 1, "hidden", "B2:C9", 8), ("a.xlsx", "last", 2, "visible", None, None)]
    rows = workbooks.read(spark, str(tmp_path), sheets="first").orderBy("row_no").collect()
    assert [(r["sheet"], r["row_no"], {i: c for i, c in enumerate(r["cells"]) if c}) for r in rows] == [("first", 0, {0: "head"}), ("first", 2, {1: "rich text", 4: "2.5", 27: "far"}), ("first", 3, {2: "no number"})]
    assert [r["cells"] for r in workbooks.read(spark, f"file://{tmp_path}/*.xlsx", sheets="first", columns="AB,B").orderBy("row_no").collect()] == [["", ""], ["far", "rich text"], ["", ""]]
    assert [r["item_code"] for r in files.read_workbooks(spark, str(tmp_path)).orderBy("row_no").collect()] == ["rich text", None]
    assert workbooks.read(spark, str(tmp_path), sheets="nowhere").count() == 0
    assert workbooks.read(spark, str(tmp_path)).rdd.getNumPartitions() == 3  # one a sheet


def test_workbooks_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("x", "s2", 2, "a<b&\"c\u0001"), ("x", "s2", 1, None), ("x", "s1", 1, " blanks "), ("y", "only", 1, "ü\nz")], "book string, sheet string, n int, said string")
    workbooks.write(rows.withColumn("book", F.concat("book", F.lit(".xlsx"))), str(tmp_path / "out"), "book", "sheet", ["n", "said"], ["n"])
    got = [(r["file"], r["sheet"], r["row_no"], r["cells"]) for r in workbooks.read(spark, str(tmp_path / "out")).orderBy("file", "position", "row_no").collect()]
    assert got == [("x.xlsx", "s1", 0, ["n", "said"]), ("x.xlsx", "s1", 1, ["1", " blanks "]), ("x.xlsx", "s2", 0, ["n", "said"]), ("x.xlsx", "s2", 1, ["1"]), ("x.xlsx", "s2", 2, ["2", "a<b&\"c"]), ("y.xlsx", "only", 0, ["n", "said"]), ("y.xlsx", "only", 1, ["1", "ü\nz"])]
    assert [r["cell_range"] for r in workbooks.census(spark, str(tmp_path / "out")).orderBy("file", "position").collect()] == ["A1:B2", "A1:B3", "A1:B2"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.xlsx", "y.xlsx"]
    assert [workbooks.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(workbooks.column_number(workbooks.column_letters(n)) == n for n in range(2000))


def parts_of_feed(spark, tmp_path):
    every = views.changes(spark, DATA)
    for k in range(3):
        every.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return every


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    every, path = parts_of_feed(spark, tmp_path), str(tmp_path / "sink")
    run = lambda: sinks.counted_inserts(feeds.read_feed(spark, str(tmp_path / "feed"), 1), path).awaitTermination(300)
    run()
    counts = lambda: {r["severity"]: r["n"] for r in sinks.running_counts(spark, path).collect()}
    rows = lambda: sorted(tuple(r) for r in sinks.table(spark, path, "rows", "seq bigint, id bigint, severity string, status string").collect())
    new = every.filter("op = 'INSERT'")
    expected = {r["severity"]: r["count"] for r in new.groupBy("severity").count().collect()}
    assert counts() == expected and rows() == sorted(tuple(r) for r in new.select("seq", "id", "severity", "status").collect())
    # the last batch was written, but the stream stopped before it said so, and half of what it wrote is lost
    for f in (tmp_path / "sink" / "_checkpoint" / "commits").glob("*2*"):
        f.unlink()
    shutil.rmtree(tmp_path / "sink" / "counts" / "batch=2")
    assert counts() != expected
    run()
    assert counts() == expected and len(rows()) == new.count()


def test_state_of_findings_that_do_not_count_ends(spark, tmp_path):
    every = parts_of_feed(spark, tmp_path)
    ordered = every.orderBy("seq").collect()
    for k in range(4):  # in order, so that no change is late
        spark.createDataFrame(ordered[k * len(ordered) // 4 : (k + 1) * len(ordered) // 4], every.schema).coalesce(1).write.parquet(str(tmp_path / "ordered" / f"{k}"))
    feed = spark.readStream.schema(feeds.FEED).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "ordered" / "*"))
    q = feeds.open_high_changes(feed, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    n_open = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("delta")).first()[0]
    last = {}
    for r in ordered:
        last[r["id"]] = r["op"] != "DELETE" and r["status"] == "OPEN" and r["severity"] == "HIGH"
    assert n_open == sum(last.values())
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= sum(last.values()) + 2 < len(last), (kept, len(last))


def test_kpis_of_streamed_changes(spark, tmp_path):
    projects = views.projects(spark, DATA)
    rows = views.ledger(spark, DATA).limit(500).cache()
    names = rows.columns
    none = F.lit(None).cast(rows.schema)
    whole = lambda df: F.struct(*[df[c] for c in names])
    steps = [rows.select(none.alias("old"), whole(rows).alias("new"))]
    now = rows
    changed = L.with_amounts(now.withColumn("_was", F.struct(*names)).withColumn("quantity", (F.col("quantity") * 2).cast("decimal(12,2)")).withColumn("type", F.lit("SENT_VO")).withColumn("ai_rationale", F.lit(None).cast("string"))).filter("line_no = 1")
    steps.append(changed.select(F.col("_was").alias("old"), F.struct(*names).alias("new")))
    steps.append(rows.filter("line_no = 2").select(F.struct(*names).alias("old"), none.alias("new")))
    for s in steps:
        s.write.mode("append").parquet(str(tmp_path / "changes"))
    feed = spark.readStream.schema(steps[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
    sinks.ledger_deltas(feed, str(tmp_path / "kpis")).awaitTermination(300)
    after = rows.filter("line_no > 2").unionByName(changed.select(names))
    shown = lambda df: sorted(json.dumps([str(x) for x in r]) for r in df.select(sorted(df.columns)).collect())
    assert shown(sinks.streamed_kpis(spark, str(tmp_path / "kpis"), projects)) == shown(L.kpis(after, projects))


def test_stored_tables_cascade(spark, tmp_path):
    rows = {"a": [(i, i % 3) for i in range(9)], "b": [(i, i % 9, i % 3) for i in range(30)], "c": [(i, i % 30, i % 9, i % 30 % 9 % 3) for i in range(90)]}
    schemas = {"a": "id bigint, part int", "b": "id bigint, a_id bigint, part int", "c": "id bigint, b_id bigint, seen_by bigint, part int"}
    held = {n: stored.StoredTable(str(tmp_path / n), ["part"]) for n in rows}
    for n, r in rows.items():
        spark.createDataFrame(r, schemas[n]).write.partitionBy("part").parquet(held[n].path)
    graph = [Reference("b", "a_id", "a"), Reference("c", "b_id", "b"), Reference("c", "seen_by", "a", cascade=False)]
    before = snapshot(held["b"].path)
    done = stored.delete_cascade(spark, held, graph, {"a": spark.createDataFrame([(3,), (77,)], "id bigint")})
    b = [r for r in rows["b"] if r[1] != 3]
    c = [(i, x, None if s == 3 else s, p) for i, x, s, p in rows["c"] if x in {r[0] for r in b}]
    got = {n: sorted((tuple(r) for r in spark.read.parquet(held[n].path).select(*[x.split()[0] for x in schemas[n].split(", ")]).collect()), key=lambda r: r[0]) for n in rows}
    assert got == {"a": [r for r in rows["a"] if r[0] != 3], "b": b, "c": c}
    assert done["a"] == done["b"] == 1 and {n: v for n, v in snapshot(held["b"].path).items() if v[0] != "part=0"} == {n: v for n, v in before.items() if v[0] != "part=0"}
