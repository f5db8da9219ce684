"""Short benchmark items: every text that the tolerance allows is met."""

import math
from itertools import product

from pyspark.sql import functions as F

from claimspark.llm import decontam


def test_op6_items_of_any_length_with_any_replaced_word(spark):
    items, texts, expected = [], [], {}
    for n in range(3, 15):
        w = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        allowed = min(n, 13) - math.ceil(round(min(n, 13) * 0.84, 9))
        for out, lead in product(range(-1, n), (0, 3)):
            key = 1000 * n + 10 * (out + 1) + lead
            texts.append((key, " ".join(["lead"] * lead + ["zz" if k == out else x for k, x in enumerate(w)] + ["tail"] * (lead // 3))))
            expected[key] = [n] if n >= decontam.SHORTEST and (out < 0 or allowed) or n == 14 else None
    for n in (7, 8):  # two replaced words are too many
        texts.append((n, " ".join("zz" if k in (1, 4) else f"i{n}x{k}" for k in range(n))))
        expected[n] = None
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["_items"] for r in decontam.flag_contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == expected


def test_op6_large_benchmarks_are_sieved(spark, monkeypatch):
    """With the seeds not broadcast, the same is found, and few other seeds are left for the shuffle."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda: sorted((r["doc_id"], r["_items"], r["_hits"]) for r in decontam.flag_contaminated(docs, bench).filter("_items is not null").collect())
    whole = found()
    monkeypatch.setattr(decontam, "SEEDS", 0)
    assert found() == whole and whole
    seeds = spark.range(5000).select(F.xxhash64("id").alias("seed"))
    others = spark.range(5000, 205_000).select(F.xxhash64("id").alias("seed"))
    assert decontam.sieved(seeds, seeds, 5000).count() == 5000
    assert decontam.sieved(others, seeds, 5000).count() < 4000
