"""Queries on made tables and on repeated ones, against their SQL and against plain counts."""
import datetime as dt
import os
import random
from functools import reduce

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare
from tidemark.operators import reports as rpt

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SMALL = "/root/testdata/sf0.001"


def tables_with(folder, **made):
    """A data folder: the smallest tables, some of them replaced."""
    for name in TABLES:
        if name in made:
            con = duckdb.connect()
            con.register("made", made[name])
            con.sql(f"COPY (SELECT * FROM made) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SMALL}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


def lines(rows):
    """Line items from (supplier, day, order, price, quantity)."""
    return pd.DataFrame([(o, 1, s, 1, float(q), float(p), 0.0, 0.0, "N", "O", dt.datetime(1996, 1, 1) + dt.timedelta(d)) for s, d, o, p, q in rows],
                        columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
                        ).astype({"l_linenumber": "int32", "l_shipdate": "datetime64[us]"})


@pytest.mark.parametrize("name,rule,n", [("val_01_bar_checks", "symbol_present", 19), ("val_02_eod_checks", "adjVolume_present", 29), ("val_08_replay_contract", "signal_ternary", None)])
def test_whole_volumes_do_not_depend_on_the_order_of_ticks(spark, tmp_path, name, rule, n):
    """Volumes that are whole numbers, from ticks whose sum of doubles ends just below some of them."""
    rng, rows, whole = random.Random(1), [], []
    for s in range(400):
        cents = [rng.randrange(100_000, 900_000) for _ in range(9)]
        cents.append(-sum(cents) % 1000 + 100_000)
        rows += [(s, 0, 10 * s + i, c / 100, 1 + s % 7) for i, c in enumerate(cents)]
        whole.append((sum(cents) + 1000 * 1000 * len(cents) * (1 + s % 7)) // 1000)
    folder = tables_with(tmp_path, lineitem=lines(rows))
    assert any(int(reduce(lambda a, r: a + (r[4] * 1000 + r[3] / 10), rows[10 * s:10 * s + 10], 0.0)) != v for s, v in enumerate(whole))
    want = sum(v % n == 0 if n else v % 4 == 3 for v in whole)
    got = {r.rule: r.n_violations for r in QUERIES[name](spark, folder).collect()}
    assert got[rule] == want
    ok, note, _ = compare(spark, folder, QUERIES[name], SQL[name])
    assert ok, note


def test_spearman_of_short_and_constant_series(spark, tmp_path):
    """Fewer than three pairs, or a constant side, have no rank correlation on either side."""
    rows = [(s, d, 100 * s + d, 1000 + (0 if s == 9 else (d * d * 37 + s) % 211 * 100), 1) for s, days in ((1, 3), (2, 4), (3, 5), (4, 30), (9, 8)) for d in range(days)]
    folder = tables_with(tmp_path, lineitem=lines(rows))
    got = {r.symbol: r.rho for r in QUERIES["sta_12_spearman"](spark, folder).collect()}
    assert got["S2"] is None and got["S9"] is None and got["S4"] is not None
    ok, note, _ = compare(spark, folder, QUERIES["sta_12_spearman"], SQL["sta_12_spearman"])
    assert ok, note


def test_composite_ranking_of_metrics_that_change_when_computed_again(spark):
    """A value is ranked as it was first computed: computed again, its last bit may differ."""
    from pyspark.sql import functions as F

    @F.udf("double")
    def noisy(x):
        import random

        return x + random.random() * 1e-9

    rows = [(run, regime, float(k)) for k, run in enumerate("abc") for regime in ("x", "y", "z")]
    metrics = spark.createDataFrame(rows, "run string, regime string, base double").withColumn("sharpe", noisy.asNondeterministic()("base"))
    got = {r.run: (r.mean_rank, r.composite_rank) for r in rpt.composite_ranking(metrics).collect()}
    assert got == {"c": (1.0, 1), "b": (2.0, 2), "a": (3.0, 3)}


def test_feature_stats_of_repeated_symbols(spark, tmp_path):
    """Copies of a symbol have equal values: they tie in ranks and bins wherever they stand."""
    src = f"'{SMALL}/lineitem.parquet'"
    copies = duckdb.sql(f"SELECT * EXCLUDE (i) REPLACE (l_orderkey + i * 100000 AS l_orderkey, l_suppkey + i * 10 AS l_suppkey) FROM {src}, range(6) r(i)").df()
    folder = tables_with(tmp_path, lineitem=copies)
    ok, note, _ = compare(spark, folder, QUERIES["mon_10_feature_stats"], SQL["mon_10_feature_stats"])
    assert ok, note


def test_shuffled_columns_move_each_row_once(spark):
    """The rows are moved once, whatever the number of features and repeats, and the values of a window stay in it."""
    from pyspark.sql import functions as F

    from tidemark.operators.panel import permuted_predictions

    pred = spark.range(120).select(
        (F.col("id") % 2).alias("fold"), F.concat(F.lit("S"), (F.col("id") % 6).cast("string")).alias("symbol"),
        F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(0.0).alias("y_pred"), F.col("id").cast("double").alias("a"),
        (F.col("id") * -1.0).alias("b"), F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("beta"))
    out = permuted_predictions(pred, ["a", "b"], ["a", "b"], 7)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = out.toPandas()
    assert len(rows) == 120 * 2 * 7 and set(out.columns) == {*pred.columns, "feature", "repeat"}
    for (feature, *_), g in rows.groupby(["feature", "repeat", "fold", "symbol"]):
        assert sorted(g.y_pred + g[feature]) == sorted(g[feature])
    assert (rows.y_pred != 0).any()


def test_landed_parts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table that lands in parts is written by as many tasks as it has splits, and still comes in five batches."""
    from tidemark.plans import streams_q
    from tidemark.sources.derive import Tables

    monkeypatch.setattr(streams_q, "scratch_dir", lambda _: str(tmp_path))
    spark.range(8000).selectExpr("id AS event_id", "timestamp_seconds(id * 60) AS ts").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    stream = streams_q.table(Tables(spark, str(tmp_path)), "events", "ts")
    (stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
     .foreachBatch(lambda b, i: seen.append((b.count(), b.agg({"ts": "min"}).first()[0]))).start().awaitTermination())
    assert len(list((tmp_path / "landing").glob("*.parquet"))) > 5
    assert len(seen) == 5 and sum(n for n, _ in seen) == 8000
    assert seen[-1][1] == min(t for _, t in seen) < seen[0][1]


def test_long_frames_from_short_ones(spark):
    """Sums and spreads put together from short frames are those of the long ones, gaps, spikes and flat stretches included."""
    from pyspark.sql import functions as F

    from tidemark.operators import windows as win

    rng = random.Random(4)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(d), None if s == "B" and d % 90 == 40 else 0.25 if 100 < d < 200 else 1e12 if d == 220 else rng.gauss(0, 1))
            for s in "AB" for d in range(400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double")
    out = win.in_blocks(df, {"x": ("x", (14, 50, 200))}, {"x": (21, 63)})
    plain = {f"_sum_x_{n}": win.rolling_sum("x", n) for n in (14, 50, 200)} | {f"_std_x_{n}": win.rolling_std("x", n) for n in (21, 63)}
    both = out.withColumns({f"w{c}": v for c, v in plain.items()}).toPandas()
    for c in plain:
        assert (both[c].isna() == both[f"w{c}"].isna()).all() and both[c].notna().any()
        seen = both[both[c].notna()]
        assert seen[c].to_numpy() == pytest.approx(seen[f"w{c}"].to_numpy(), rel=1e-9, abs=1e-9)
    assert (both["_std_x_63"] == 0).sum() == (both["w_std_x_63"] == 0).sum() > 0
    frames = out._jdf.queryExecution().analyzed().toString()
    assert "-199" not in frames and "-62" not in frames


def test_columns_are_counted_without_becoming_rows(spark):
    """Values of all columns are counted over columns; gaps, infinities, signed zeros and rows without a day included."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import monitor as mon

    rng = random.Random(7)
    special = (None, float("nan"), 0.0, -0.0, 5e-324, -3.5)
    rows = [(None if i % 97 == 0 else dt.datetime(2020, 1, 1) + dt.timedelta(i % 40), rng.choice(special) if i % 3 == 0 else rng.gauss(0, 10 ** (i % 5)),
             1.0 if i % 2 else None, None) for i in range(6000)]
    panel = spark.createDataFrame(rows, "ts timestamp, a double, b double, c double").repartition(5)
    days = mon.feature_days(panel, ["a", "b", "c"], recent=10)
    values, places = mon.feature_values(panel, ["a", "b", "c"], days)
    for df in (days, values):
        assert "Generate" not in df._jdf.queryExecution().analyzed().toString()
    pdf = pd.DataFrame(rows, columns=["ts", "a", "b", "c"])
    got = {(r.feature, r.day): r for r in days.collect()}
    assert len(got) == 3 * 41
    for c in "abc":
        for day, g in pdf.groupby(pdf.ts.dt.date, dropna=False)[c]:
            x, r = g.dropna().to_numpy(float), got[(c, None if pd.isna(day) else day)]
            assert (r.n_rows, r.n) == (len(g), len(x))
            if len(x):
                assert (r.mean, r.m2, r.low, r.high) == pytest.approx((x.mean(), x.var() * len(x), x.min(), x.max()), rel=1e-9, abs=1e-9)
            else:
                assert r.mean is r.low is r.high is None
    dated = pdf[pdf.ts.notna()]
    old = dated[dated.ts < pd.Timestamp(2020, 1, 31)].a.dropna().to_numpy(float)
    edges = {r.feature: r.edges for r in mon.baseline_edges(values, places).collect()}
    assert edges["a"] == pytest.approx(sorted(set(np.quantile(old, np.linspace(0, 1, 11)))), rel=1e-12) and edges["b"] == [1.0] and "c" not in edges
    bars = {r.bar: r.n for r in values.where("feature = 'a'").groupBy("bar").agg(F.sum("n").alias("n")).collect()}
    whole = pdf.a.dropna().to_numpy(float)
    assert bars == {i: n for i, n in enumerate(np.histogram(whole, 20)[0]) if n}
    assert values.where("feature = 'a' AND is_recent IS NULL").agg(F.sum("n")).first()[0] == pdf[pdf.ts.isna()].a.notna().sum()


def test_daily_document_windows_take_one_line_a_symbol(spark):
    """Windows of whole days against plain sums: gaps, days without scores, repeated bars, a lookback of no days."""
    from tidemark.operators.timejoin import document_windows

    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    docs = [(rng.choice("AB"), None if i % 50 == 0 else start + dt.timedelta(hours=rng.randrange(24 * 120)), None if i % 7 == 0 else rng.uniform(-1, 1)) for i in range(400)]
    bars = [(s, (start + dt.timedelta(d)).date()) for s in "ABC" for d in range(0, 150, 3)] * 2
    ddf, bdf = spark.createDataFrame(docs, "symbol string, published_at timestamp, sentiment_score double"), spark.createDataFrame(bars, "symbol string, ts date")
    for back in (30, 1, 0):
        out = document_windows(ddf, bdf, back)
        got = {(r.symbol, r.ts): r for r in out.collect()}
        assert len(got) == out.count() == len(set(bars))
        for s, day in set(bars):
            x = [v for k, at, v in docs if k == s and at is not None and v is not None and day - dt.timedelta(back) <= at.date() < day]
            r = got[(s, day)]
            assert (r.doc_count, r.has_coverage) == (len(x), bool(x)) and r.sentiment_score == pytest.approx(sum(x) / len(x) if x else 0.0, abs=1e-12)
    assert document_windows(ddf, bdf, 30)._jdf.queryExecution().executedPlan().toString().count("explode") == 0


def test_ranks_do_not_compute_their_columns_twice(spark, monkeypatch):
    """Where no day has many rows, the plain row counts tell so and the columns are not aggregated first."""
    from pyspark.sql import functions as F

    from tidemark.operators import ranks

    rows = spark.range(300).select(F.timestamp_seconds(F.col("id") % 3 * 86400).alias("ts"), F.col("id").cast("string").alias("symbol"), (F.col("id") % 7).cast("double").alias("x"))
    plain = {(r.symbol, r.ts): r.xs_rank_x for r in ranks.percent_rank_columns(rows, ["x"]).collect()}
    cut = {(r.symbol, r.ts): r.xs_rank_x for r in ranks.percent_rank_columns(rows, ["x"], rows=rows, crowded=20).collect()}

    def unasked(df):
        raise AssertionError("no list of crowded days is needed")

    monkeypatch.setattr(ranks, "materialized", unasked)
    assert {(r.symbol, r.ts): r.xs_rank_x for r in ranks.percent_rank_columns(rows, ["x"], rows=rows).collect()} == plain == cut


def test_trees_are_fitted_by_tasks_of_bounded_rows(spark, monkeypatch):
    """However few files the rows come in, no task of the learner gets more than its share of them."""
    from tidemark.operators import models

    seen, plain = [], models.assembled
    monkeypatch.setattr(models, "TREE_ROWS", 100)
    monkeypatch.setattr(models, "assembled", lambda df, columns: seen.append(df) or plain(df, columns))
    rows = spark.range(1050).selectExpr("id", "IF(id < 50, NULL, CAST(id % 7 AS DOUBLE)) AS a", "CAST(id % 5 AS DOUBLE) AS b", "CAST(id % 7 AS DOUBLE) AS y").coalesce(1)
    got = {r.feature: r.importance for r in models.gain_importance(rows, ["a", "b"], maxDepth=3, maxIter=2).collect()}
    assert got["a"] == pytest.approx(1.0, abs=1e-6) and got["b"] == pytest.approx(0.0, abs=1e-6)
    sizes = seen[0].rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 110


def test_buckets_of_a_large_group_grow_in_number_not_in_size(spark, monkeypatch):
    """A group is cut into as many buckets as its distinct values need; counts before a value stay exact, hot ends and NULLs included."""
    from tidemark.operators import ranks

    seen, plain = [], ranks.materialized
    monkeypatch.setattr(ranks, "materialized", lambda df: seen.append(plain(df)) or seen[-1])
    rng = random.Random(5)
    rows = [("a", x, rng.randrange(3)) for x in {round(rng.gauss(0, 1), 4) for _ in range(9000)}] + [("b", float(i), 1) for i in range(7)] + [(None, 1.0, 2)]
    out = ranks.prefix_by_value(spark.createDataFrame(rows, "g string, x double, n int"), ["g"], "x", ["n"], rows=50)
    got = {(r.g, r.x): (r.n_before, r.n_total) for r in out.collect()}
    assert len(got) == len(rows) - 1  # a group without a name has no buckets
    for g in "ab":
        line, before = sorted((x, n) for k, x, n in rows if k == g), 0
        for x, n in line:
            assert got[g, x] == (before, sum(m for _, m in line))
            before += n
    edges = {r.g: r._edges for r in seen[1].collect()}
    n = sum(g == "a" for g, *_ in rows)
    held = [sum(lo < x <= hi for g, x, _ in rows if g == "a") for lo, hi in zip([-99, *edges["a"]], [*edges["a"], 99])]
    assert len(held) >= n / 50 and max(held) <= 100
