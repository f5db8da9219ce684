"""Ordered passes by ranges, deep pages and trigram search against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import carry, pages
from claimspark.sources.shared import kept


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 1, 2, 3, 4]), i, rng.choice([None, None, i])) for i in range(600)]
    return out, spark.createDataFrame(out, "grp string, o int, id bigint, mark bigint").repartition(4)


@pytest.mark.parametrize("ranges", [None, 1, 5, 23])
def test_carried_places_and_last_values(rows, ranges):
    plain, table = rows
    expected = {}
    for g in {r[0] for r in plain}:
        last = None
        for place, r in enumerate(sorted((r for r in plain if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            expected[r[2]] = (place, last)
            last = r[3] if r[3] is not None else last
    got = carry.carried(table, ["grp"], [F.asc_nulls_first("o"), F.asc("id")], kept, place="place", last={"seen": F.col("mark")}, ranges=ranges)
    assert got.columns == ["grp", "o", "id", "mark", "place", "seen"]
    assert {r["id"]: (r["place"], r["seen"]) for r in got.collect()} == expected
    assert carry.carried(table.limit(0), ["grp"], [F.asc("id")], kept, place="place").count() == 0


def test_a_hot_group_is_dealt_out(rows, spark):
    placed = carry.in_ranges(rows[1], ["grp"], [F.asc_nulls_first("o"), F.asc("id")], kept, 8)
    assert placed.filter("grp = 'hot'").select("_range").distinct().count() > 3


@pytest.mark.parametrize("n", [1, 4, 64])
def test_pages_equal_offsets(rows, n):
    plain, table = rows
    known = pages.ranges(table, ["o", "id"], n)
    ids = [r[2] for r in sorted(plain, key=lambda r: (r[1] is None, r[1] or 0, r[2]))]
    for number, size in [(0, 10), (3, 7), (11, 50), (12, 50), (0, 1000), (59, 10), (60, 10), (999, 10)]:
        page = pages.page_with_count(table, known, number, size).collect()
        assert [r["id"] for r in page] == ids[number * size : (number + 1) * size], (number, size)
        assert all((r["n_all"], r["has_more"]) == (600, 600 >= (number + 1) * size) for r in page)
    seen, last = [], None
    while page := pages.next_page(table, ["o", "id"], last, 130).collect():
        seen, last = seen + [r["id"] for r in page], page[-1]
    assert seen == ids


def test_a_deep_page_sorts_one_range(spark, tmp_path):
    spark.range(20_000).withColumn("o", F.col("id") % 5000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    known = pages.ranges(table, ["o", "id"], 50)
    page = pages.page(table, known, 150, 100)
    assert [r["id"] for r in page.collect()] == sorted(range(20_000), key=lambda i: (i % 5000, i))[15_000:15_100]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" not in plan and "PushedFilters: [Or" in plan  # more than is seen at a glance, cut short
    held = [k for k, b in enumerate(known.before) if b < 15_100][-1]
    assert 15_000 - known.before[held] < 2_500  # what is skipped over lies in the range


def test_pages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "o int, id bigint")
    known = pages.ranges(none, ["o", "id"])
    assert known.total == 0 and pages.page(none, known, 0).count() == 0


@pytest.mark.parametrize("escape", [False, True])
def test_trigram_search_equals_the_scan(spark, escape):
    from claimspark.functions.scalars import any_ilike
    from claimspark.operators import trigrams

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcAB%_\\ בכ") for _ in range(rng.randrange(14))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t if i % 9 else None, rng.choice(["95.01", "95", None])) for i, t in enumerate(texts)], "id bigint, text string, code string").repartition(3)
    table = trigrams.postings(rows, "id", ["text", "code"], kept)
    for _ in range(40):
        words = ["".join(rng.choice("abcAB%_ בכ") for _ in range(rng.randrange(7))) for _ in range(rng.randint(1, 3))] + rng.choice([[], ["95.0"], ["a\\%b"] if escape else ["abc"]])
        scan = rows.filter(any_ilike([F.col("text"), F.col("code")], words, escape))
        assert sorted(r["id"] for r in trigrams.search(rows, table, "id", ["text", "code"], words, escape).collect()) == sorted(r["id"] for r in scan.collect()), words
    assert trigrams.search(rows, table, "id", ["text"], []).count() == 0
    assert trigrams.pieces("ab%cde_fghi", False) == ["cde", "fgh", "ghi"] and trigrams.pieces("a%bc", True) == ["a%b", "%bc"] and trigrams.pieces("a\\%bc", False) == ["a%b", "%bc"]
