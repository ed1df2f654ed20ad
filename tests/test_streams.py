"""Streams read one file per batch, oldest rows last, against the same rows in one piece."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.lake import Lake
from tidemark.streaming import streams as sm

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def landed(spark, tmp_path):
    """Writes rows as five files, the newest rows first; returns the stream and a lake."""
    def land(rows, schema, ts):
        rows = sorted(rows, key=lambda r: r[ts], reverse=True)
        for k in range(5):
            part = rows[k * len(rows) // 5:(k + 1) * len(rows) // 5]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return sm.landing_stream(spark, str(tmp_path / "in"), files_per_trigger=1), Lake(spark, str(tmp_path / "lake")), str(tmp_path / "cp")
    return land


def ticks():
    rng = random.Random(1)
    return [(f"S{rng.randrange(3)}", T0 + dt.timedelta(hours=rng.randrange(24 * 40)), rng.random(), 1.0, k) for k in range(300)]


def test_tick_bars_lose_nothing_and_rerun_the_same(spark, landed):
    rows, schema = ticks(), "symbol string, ts timestamp, px double, qty double, k long"
    stream, lake, cp = landed(rows, schema, 1)
    for _ in range(2):  # the second run finds nothing new
        sm.part_stream(stream, lake, "parts", cp, sm.tick_parts).awaitTermination()
    assert lake.read("parts").select("batch").distinct().count() == 5
    got = {tuple(r) for r in sm.bars_of_parts(lake.read("parts")).collect()}
    whole = sm.bars_of_parts(sm.tick_parts(spark.createDataFrame(rows, schema)))
    assert got == {tuple(r) for r in whole.collect()} and sum(r[6] for r in got) == len(rows)


def test_document_windows_lose_nothing(spark, landed):
    rows = [(s, t, p) for s, t, p, _, _ in ticks()]
    schema = "symbol string, published_at timestamp, sentiment_score double"
    stream, lake, cp = landed(rows, schema, 1)
    sm.part_stream(stream, lake, "parts", cp, sm.document_parts).awaitTermination()
    got = {(r.symbol, r.ts): r.doc_count for r in sm.windows_of_parts(lake.read("parts"), "7 days").collect()}
    want = {}
    for s, t, _ in rows:
        for k in range(7):
            end = dt.datetime.combine(t.date(), dt.time()) + dt.timedelta(days=k + 1)
            want[s, end] = want.get((s, end), 0) + 1
    assert got == want


def test_first_versions_over_batches(spark, landed):
    rows = [(i % 60, T0 + dt.timedelta(days=i), "v") for i in range(100)]
    stream, lake, cp = landed(rows, "id long, ts timestamp, body string", 1)
    sm.first_version_stream(stream, lake, "docs", cp, "id").awaitTermination()
    assert sorted(r.id for r in lake.read("docs").collect()) == list(range(60))


def test_orders_follow_event_time(spark, landed):
    rng = random.Random(2)
    rows = [(s, T0 + dt.timedelta(days=d), float(rng.choice([100, -50]))) for s in ("A", "B") for d in range(50)]
    stream, lake, cp = landed(rows, "symbol string, ts timestamp, target_qty double", 1)
    sm.part_stream(stream, lake, "targets", cp, lambda batch: batch).awaitTermination()
    got = {(r.symbol, r.ts): r.delta for r in sm.orders_of_targets(lake.read("targets")).collect()}
    want, held = {}, {}
    for s, t, q in sorted(rows):
        if q != held.get(s, 0.0):
            want[s, t] = q - held.get(s, 0.0)
        held[s] = q
    assert got == want


def test_flat_upsert_survives_a_stop_between_delete_and_write(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    for k in "abc":
        lake.upsert(row(k, 1), "t", ["k"], "v")
    lake.read("t").write.parquet(f"{tmp_path}/staging/t")  # staged, then stopped after the delete
    lake._remove(lake.path("t"))
    lake.upsert(row("d", 1), "t", ["k"], "v")
    assert sorted(r.k for r in lake.read("t").collect()) == ["a", "b", "c", "d"]
    assert not lake._exists(f"{tmp_path}/staging/t")


def test_a_key_that_changes_partition_leaves_the_old_one(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    schema = "k string, month int, v int"
    lake.upsert(spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 2, 1)], schema), "t", ["k"], "v", ["month"])
    lake.upsert(spark.createDataFrame([("a", 2, 2), ("b", 3, 2)], schema), "t", ["k"], "v", ["month"])
    assert sorted((r.k, r.month) for r in lake.read("t").collect()) == [("a", 2), ("b", 3), ("c", 2)]


def test_other_errors_are_not_taken_for_an_absent_table(spark, tmp_path):
    spark.range(1).select(F.col("id").alias("x")).write.parquet(f"{tmp_path}/processed/t")
    with pytest.raises(Exception, match="ts"):
        Lake(spark, str(tmp_path)).high_water("t", "ts").collect()
