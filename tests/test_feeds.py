"""Streams replayed from files give the batch results."""

from pyspark.sql import functions as F

from claimspark.operators import changes
from claimspark.sources import views
from claimspark.streaming import feeds, sinks


def replay(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_feeds_equal_batch(spark, tmp_path):
    all_ = views.changes(spark, "/root/testdata/sf0.001")
    for k in range(3):
        all_.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = lambda: feeds.read_feed(spark, str(tmp_path / "feed"), 1)
    assert replay(feeds.inserts(feed()), "append", "inserted").count() == all_.filter("op = 'INSERT'").count()
    counted = {r["severity"]: r["n"] for r in replay(feeds.insert_counts(feed()), "complete", "counted").collect()}
    assert counted == {r["severity"]: r["count"] for r in all_.filter("op = 'INSERT'").groupBy("severity").count().collect()}
    now = changes.latest_state(all_).filter("status = 'OPEN' and severity = 'HIGH'").count()
    assert replay(feeds.open_high_changes(feed()), "append", "deltas").agg(F.sum("delta")).first()[0] == now


def test_a_batch_for_one_table_is_not_kept(spark, tmp_path):
    """Rows that are kept are many times their files, and a task would read all that is kept of its files."""
    views.changes(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "feed"))
    kept = []

    def same(batch):
        kept.append(batch.is_cached)
        return batch

    for names in (["one"], ["one", "two"]):
        sinks.each_batch_once(feeds.read_feed(spark, str(tmp_path / "feed")), str(tmp_path / f"to{len(names)}"), dict.fromkeys(names, same)).awaitTermination()
        for name in names:
            assert sinks.table(spark, str(tmp_path / f"to{len(names)}"), name, feeds.FEED).count() == views.changes(spark, "/root/testdata/sf0.001").count()
    assert kept == [False, True, True]
