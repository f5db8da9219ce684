"""What a task is given grows neither with a hot group nor with the tables."""

from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from claimspark import catalog
from claimspark.operators import carry, documents, letters
from claimspark.plans import claims
from claimspark.sources import shared


def test_pairs_of_one_project_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, "hot" if i < 90 else "b", "CONTRACT" if i % 3 else "EXECUTION") for i in range(97)] + [(200, None, "CONTRACT"), (201, None, "EXECUTION")], "id bigint, project_id string, category string")
    expected = []
    for p, ids in (("hot", range(90)), ("b", range(90, 97))):
        pairs = [(c, e) for c in ids if c % 3 for e in ids if not e % 3]
        expected += [(p, c, e, k, 10 + int(k / len(pairs) * 70 + 0.5)) for k, (c, e) in enumerate(pairs)]
    got = documents.pairs_in_project(docs, block=7, pairs=100).withColumn("task", F.spark_partition_id()).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    assert max(Counter(r["task"] for r in got if r["project_id"] == "hot").values()) < 1000 and documents.pairs_in_project(docs.limit(0)).count() == 0


def test_a_pair_takes_little_of_the_disk(spark, tmp_path):
    """All pairs are written, with steps as differences: they took 4 bytes a pair. No list of ids is unfolded to pairs."""
    spark.range(4000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text", "IF(id % 2 = 0, 'en', 'de') AS lang", "IF(id < 3600, 'hot', 'b') AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pairs, before = claims.contracts_by_executions(spark, str(tmp_path)), spark.conf.getAll
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.count("REPARTITION_BY_NUM") == 4  # blocks, before their rows are repeated for units, and units
    pairs.write.parquet(out := f"{tmp_path}/pairs")
    n, files = 1800**2 + 200**2, [*(tmp_path / "pairs").glob("*.parquet")]
    assert sum(f.stat().st_size for f in files) < n / 2 and spark.conf.getAll == before
    metas = [pq.ParquetFile(f).metadata for f in files]
    assert {m.row_group(g).column(3).encodings for m in metas for g in range(m.num_row_groups)} == {("DELTA_BINARY_PACKED",)}
    got = spark.read.parquet(out).groupBy("project_id").agg(F.count("*"), F.countDistinct("step"), F.max("step"), F.countDistinct("contract_id", "execution_id"), F.min("progress"), F.max("progress"))
    assert {tuple(r) for r in got.collect()} == {("hot", 1800**2, 1800**2, 1800**2 - 1, 1800**2, 10, 80), ("b", 200**2, 200**2, 200**2 - 1, 200**2, 10, 80)}


def test_more_partitions_on_larger_tables(spark, monkeypatch):
    assert shared.sized(spark, 2_000_000) is spark  # four partitions are enough
    own = shared.sized(spark, 2_000_001)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) == 5 and int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    assert own.conf.get("spark.sql.session.timeZone") == "UTC"
    for size, n in [("10485760b", 10485760), ("8m", 8 << 20), ("256KB", 256 << 10), ("-1", -1), ("64MB", 64 << 20)]:
        assert shared._bytes(size) == n
    monkeypatch.setattr(shared.sized, "__defaults__", (700,))
    for name in ("letter_rows", "appendix_rows", "price_priority"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" in plan and ", 4)" not in plan and ", 9)" in plan, name


def test_export_makes_the_ledger_once(spark, tmp_path):
    """Places are equal with windows, with ranges for all groups, and in a plain version; the ledger's text is made once and shuffled once."""
    ledger = spark.sql("""SELECT IF(id % 7 = 0, NULL, id % 3) AS project_id, date_add(DATE'2024-01-01', CAST(id * 37 % 50 AS INT)) AS created_at, id AS letter_id, 'BASE_CONTRACT' AS type, 'c' AS item_code, concat('d', id) AS description, 'u' AS unit,
      CAST(id AS DECIMAL(15,2)) AS quantity, CAST(1 AS DECIMAL(15,2)) AS unit_price_excl_vat, CAST(id AS DECIMAL(15,2)) AS total_price_excl_vat, CAST(0 AS DECIMAL(5,4)) AS markup_percentage, CAST(1 AS DECIMAL(15,2)) AS vat_amount, CAST(id + 1 AS DECIMAL(15,2)) AS total_price_incl_vat FROM range(300)""")
    plain = {}
    for p in (0, 1, 2, None):
        own = sorted((i * 37 % 50, i) for i in range(300) if (None if i % 7 == 0 else i % 3) == p)
        plain |= {f"d{i}": (p, k) for k, (_, i) in enumerate(own, 1)}
    results = [letters.export_rows(ledger, tie=["letter_id"], most=most) for most in (1_000_000, 80, 0)]
    plan = results[0]._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and plan.count("Exchange") == 1  # of rows, by their project
    for got in results:
        rows = got.collect()
        assert {r["c3"]: (r["project_id"], r["place"]) for r in rows if r["section"] == 0} == plain and len(rows) == 300 + 4 * 6
    assert Counter(map(tuple, results[0].collect())) == Counter(map(tuple, results[1].collect()))


def test_price_priority_reads_the_ledger_once(spark):
    plan = catalog.queries()["price_priority"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_returnflag") and plan.count("lineitem.parquet") == 1


def test_export_shuffles_what_a_row_cannot_do_without(spark):
    """Amounts and texts follow from narrow rows behind the shuffle, and projects' sums need no shuffle of their own."""
    for name in ("export_rows", "export_lines"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        read = [x for x in plan.split("\n") if "ReadSchema" in x]
        assert len(read) == 1 and "unit_price_excl_vat" in read[0] and not any(c in read[0] for c in ("vat_amount", "total_price", "vat_rate", "item_code", "unit:")), name
        assert plan.count("Exchange") == 1, name


def test_crowded_groups_are_counted_by_hash_first(spark):
    rows = spark.sql("SELECT IF(id < 50, NULL, IF(id < 90, 7, id)) AS k FROM range(200)")
    for slots in (1, 3, 1 << 14):
        assert {r["k"] for r in carry.crowded(rows, ["k"], 39, slots).collect()} == {None, 7}
        assert {r["k"] for r in carry.crowded(rows, ["k"], 40, slots).collect()} == {None}
    assert carry.crowded(rows, ["k"], 50) is None


def test_export_completes_rows_in_all_ways(spark):
    rows = spark.sql("""SELECT id % 3 AS project_id, date_add(DATE'2024-01-01', CAST(id % 7 AS INT)) AS created_at, id, IF(id % 2 = 0, 'BASE_CONTRACT', 'PENDING_VO') AS type FROM range(100)""")

    def complete(r):
        money = {c: F.col("id").cast("decimal(15,2)") for c in ("quantity", "unit_price_excl_vat", "total_price_excl_vat", "vat_amount", "total_price_incl_vat", "markup_percentage")}
        return r.withColumns({c: F.lit("x") for c in ("item_code", "description", "unit")} | money)

    expected = Counter(map(tuple, letters.export_rows(complete(rows), tie=["id"]).collect()))
    sums = {p: sum(i for i in range(100) if i % 3 == p) for p in range(3)}
    assert {r[0]: r[-1] for r in expected if r[1] == 1 and r[2] == 5} == {p: f"{n}.00" for p, n in sums.items()}
    for most in (1_000_000, 33, 0):
        assert Counter(map(tuple, letters.export_rows(rows, tie=["id"], most=most, complete=complete).collect())) == expected


def test_many_partitions_do_not_stand_for_small_tasks(spark):
    """AQE would join 200 partitions to a few of 64 MB, and broadcast sides that grow."""
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", 200)
    assert shared.sized(wide, 6_000_000) is wide
    own = shared.sized(wide, 6_000_001)
    assert own is not wide and own.conf.get("spark.sql.shuffle.partitions") == "200"
    assert shared._bytes(own.conf.get("spark.sql.autoBroadcastJoinThreshold")) == shared.BROADCAST_BYTES and shared._bytes(own.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == shared.JOINED_BYTES
    assert shared.sized(wide, 100_000_001).conf.get("spark.sql.shuffle.partitions") == "201"
