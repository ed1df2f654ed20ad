"""Streaming queries: the stream is run to its end, then its table is returned."""
from pyspark.sql import functions as F

from tidemark.plans.registry import query, r6
from tidemark.sources.lake import Lake, scratch_dir
from tidemark.streaming import streams as sm


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


def place(t):
    root = scratch_dir(t.spark)
    return Lake(t.spark, root), f"{root}/checkpoints"


#: Batches of a table that lands in parts.
FILES = 5


def table(t, name, order=None):
    """A table as a stream of one file; or, by ``order``, cut into five parts, the oldest rows landing
    last. A part has as many files as the table has splits, so no task reads or writes a whole
    part; a batch takes a fifth of the files."""
    if order is None:
        return sm.landing_stream(t.spark, t.dir, f"{name}.parquet")
    landed = f"{scratch_dir(t.spark)}/landing"
    rows = t.spark.read.parquet(f"{t.dir}/{name}.parquet")
    ends = rows.select(F.percentile_approx(F.unix_micros(F.col(order).cast("timestamp")), [i / FILES for i in range(1, FILES)], 1000)).first()[0]
    low = F.unix_micros(F.col(order).cast("timestamp"))
    part = sum((F.when(low > e, 1).otherwise(0) for e in ends), F.lit(0))
    for k in reversed(range(FILES)):
        rows.where(part == k).write.mode("append").parquet(landed)
    n = len(t.spark.read.parquet(landed).inputFiles())
    return sm.landing_stream(t.spark, landed, files_per_trigger=-(-n // FILES))


def ticks(stream):
    k = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey") % 1048576
    return stream.select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"),
                         (100 + F.col("l_extendedprice") / 20011.7).alias("px"),
                         (F.col("l_quantity") * 1000 + F.col("l_extendedprice") / 10).alias("qty"), k.alias("k"))


@query("stm_01_incremental_landing", "SELECT event_type, count(*) AS n_rows, max(ts) AS latest FROM events GROUP BY 1")
def _(t):
    lake, cp = place(t)
    # Run twice: the second run finds nothing new.
    for _ in range(2):
        sm.append_stream(table(t, "events"), lake.path("events"), cp).awaitTermination()
    return lake.read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("latest"))


@query("stm_02_revision_upsert", """
SELECT o_custkey, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def _(t):
    lake, cp = place(t)
    s = table(t, "orders", "o_orderdate").select("o_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"))
    sm.upsert_stream(s, lake, "latest_orders", ["o_custkey"], cp, version=F.col("last_order")).awaitTermination()
    return lake.read("latest_orders").select("o_custkey", "last_order", "status")


@query("stm_03_duplicate_documents", "SELECT event_id, user_id FROM events")
def _(t):
    lake, cp = place(t)
    e = table(t, "events", "ts").select("event_id", "user_id", "ts")
    twice = e.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    sm.first_version_stream(twice, lake, "unique_events", cp, "event_id").awaitTermination()
    return lake.read("unique_events").select("event_id", "user_id")


@query("stm_09_tick_bars", f"""SELECT symbol, ts, {r6('open','open')}, {r6('high','high')}, {r6('low','low')}, {r6('"close"','"close"')}, {r6('volume','volume',3)} FROM bars""")
def _(t):
    lake, cp = place(t)
    sm.part_stream(ticks(table(t, "lineitem", "l_shipdate")), lake, "bar_parts", cp, sm.tick_parts).awaitTermination()
    return sm.bars_of_parts(lake.read("bar_parts")).select("symbol", "ts", *[r(c, c) for c in ("open", "high", "low", "close")], r("volume", "volume", 3))


@query("stm_04_late_partition_rewrite", """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS n_bars FROM bars GROUP BY 1, 2""")
def _(t):
    lake, cp = place(t)
    sm.part_stream(ticks(table(t, "lineitem", "l_shipdate")), lake, "bar_parts", cp, sm.tick_parts).awaitTermination()
    bars = sm.bars_of_parts(lake.read("bar_parts")).withColumns({"year": F.year("ts"), "month": F.month("ts"), "_version": F.lit(0).cast("bigint")})
    lake.upsert(bars, "bars", ["symbol", "ts"], "_version", ["year", "month"], fixed_partitions=True)
    late = lake.read("bars").where("year = 1999 AND month = 2").withColumns({"close": F.col("close") + 1, "_version": F.lit(99).cast("bigint")})
    lake.upsert(late, "bars", ["symbol", "ts"], "_version", ["year", "month"], fixed_partitions=True)
    return lake.read("bars").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_bars"))


@query("stm_07_sliding_documents", f"""
WITH w AS (SELECT symbol, published_at, sentiment_score, unnest(range(30)) AS j FROM docs),
e AS (SELECT symbol, date_trunc('day', published_at) + INTERVAL 1 DAY + INTERVAL 1 DAY * j AS ts, sentiment_score FROM w)
SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, {r6('avg(sentiment_score)','sentiment_score')}, count(*) AS doc_count FROM e GROUP BY 1, 2""")
def _(t):
    from tidemark.sources.derive import scored_documents

    lake, cp = place(t)
    sm.part_stream(scored_documents(table(t, "events", "ts")), lake, "doc_parts", cp, sm.document_parts).awaitTermination()
    return sm.windows_of_parts(lake.read("doc_parts")).select("symbol", "ts", r("sentiment_score", "sentiment_score"), "doc_count")


@query("stm_06_feed_freshness", """
SELECT event_type AS name, round((epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(max(ts))) / 86400000000.0::DOUBLE, 2) AS age_days, 'fresh' AS status FROM events GROUP BY 1""")
def _(t):
    lake, cp = place(t)
    now = F.lit("2024-01-31 06:00:00").cast("timestamp")
    sm.freshness_stream(table(t, "events"), "event_type", "ts", now, lake, "feed_status", cp).awaitTermination()
    return lake.read("feed_status").select("name", "age_days", "status")


@query("stm_08_position_state", f"""
WITH b AS (SELECT symbol, ts, CASE WHEN "close" > open THEN 100.0 ELSE -50.0 END AS q FROM bars)
SELECT symbol, ts, q - coalesce(lag(q) OVER (PARTITION BY symbol ORDER BY ts), 0) AS delta FROM b QUALIFY abs(delta) >= 1e-9""")
def _(t):
    lake, cp = place(t)
    days = type(t)(t.spark, f"{lake.root}/daily")
    t.bars().write.parquet(f"{days.dir}/daily.parquet")
    targets = table(days, "daily", "ts").select("symbol", "ts", F.when(F.col("close") > F.col("open"), 100.0).otherwise(-50.0).alias("target_qty"))
    sm.part_stream(targets, lake, "targets", cp, lambda batch: batch).awaitTermination()
    return sm.orders_of_targets(lake.read("targets")).select("symbol", "ts", "delta")


@query("stm_05_source_status", """
SELECT 'events' AS name, 'ok' AS status, count(*) AS n_rows FROM events UNION ALL SELECT 'orders', 'ok', count(*) FROM orders
UNION ALL SELECT 'absent', 'failed: AnalysisException', 0""")
def _(t):
    lake, cp = place(t)

    def starter(name):
        return lambda: sm.append_stream(table(t, name), lake.path(name), f"{cp}/{name}")

    status = t.spark.createDataFrame(sm.run_sources({n: starter(n) for n in ("events", "orders", "absent")}), "name string, status string")
    counts = [lake.read(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows")) for n in ("events", "orders")]
    return status.join(counts[0].unionByName(counts[1]), "name", "left").na.fill(0, ["n_rows"])
