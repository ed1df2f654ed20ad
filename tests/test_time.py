"""Time joins on date-coded fixtures, dates, folds."""
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import splits as spl
from tidemark.operators import timejoin as tj

DAY0 = dt.date(2023, 1, 2)


def test_macro_lag_delivers_the_published_observation(spark):
    """Each value is the day number of its own observation date."""
    days = [DAY0 + dt.timedelta(days=i) for i in range(40)]
    obs = [("DGS10", dt.datetime.combine(d, dt.time()), float(i)) for i, d in enumerate(days) if d.weekday() < 5]
    macro = spark.createDataFrame(obs, "series_id string, timestamp timestamp, value double")
    bars = spark.createDataFrame([("A", dt.datetime.combine(d, dt.time())) for d in days], "symbol string, ts timestamp")
    got = {r.ts.date(): r.DGS10 for r in tj.attach_macro(bars, macro, ["DGS10"], "2023-01-02", "2023-03-01", {"DGS10": 1}).collect()}
    for d in days:
        known = [i for i, o in enumerate(days) if o.weekday() < 5 and np.busday_offset(o, 1) <= np.datetime64(d)]
        assert got[d] == (float(max(known)) if known else None)


@pytest.mark.parametrize("direction,exact", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof_join_against_brute_force_with_hot_key(spark, direction, exact):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    when = lambda: t0 + dt.timedelta(minutes=30 * rng.randrange(0, 24 * 2 * 12))
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}"
    left = [(i, key(), when()) for i in range(300)]
    right = list({(k, t): (k, t, float(i)) for i, (k, t) in enumerate((key(), when()) for _ in range(250))}.values())
    ls = spark.createDataFrame(left, "id long, k string, t timestamp")
    rs = spark.createDataFrame(right, "k string, rt timestamp, v double")
    got = {r.id: r.v for r in tj.asof_join(ls, rs, ["k"], "t", "rt", ["v"], direction, exact).collect()}
    for i, k, t in left:
        if direction == "backward":
            c = [(rt, v) for rk, rt, v in right if rk == k and (rt <= t if exact else rt < t)]
            want = max(c)[1] if c else None
        else:
            c = [(rt, v) for rk, rt, v in right if rk == k and (rt >= t if exact else rt > t)]
            want = min(c)[1] if c else None
        assert got[i] == want


def test_document_window_is_strict_at_both_grains(spark):
    bar = dt.datetime(2024, 2, 1)
    docs = [("A", bar, 9.0), ("A", bar - dt.timedelta(seconds=1), 1.0), ("A", bar - dt.timedelta(days=30), 3.0),
            ("A", bar - dt.timedelta(days=30, seconds=1), 50.0)]
    d = spark.createDataFrame(docs, "symbol string, published_at timestamp, sentiment_score double")
    b = spark.createDataFrame([("A", bar)], "symbol string, ts timestamp")
    for ts in ("timestamp", "date"):
        r = tj.document_windows(d, b.withColumn("ts", F.col("ts").cast(ts)), 30).first()
        assert (r.doc_count, r.sentiment_score, r.has_coverage) == (2, 2.0, True)


def test_an_intraday_bar_does_not_see_the_same_day_ahead(spark):
    day = dt.datetime(2024, 2, 1)
    d = spark.createDataFrame([("A", day.replace(hour=16), 1.0), ("A", day.replace(hour=9, minute=30), 5.0), ("A", day.replace(hour=9), 3.0)],
                              "symbol string, published_at timestamp, sentiment_score double")
    b = spark.createDataFrame([("A", day.replace(hour=9, minute=30), 1.0), ("A", day.replace(hour=17), 1.0)], "symbol string, ts timestamp, close double")
    got = [(r.ts.hour, r.doc_count, r.sentiment_score) for r in tj.document_windows(d, b, 30).orderBy("ts").collect()]
    assert got == [(9, 1, 3.0), (17, 3, 3.0)]


def crowded_line(spark, n=6000):
    """A third of all rows at one key and day, and a third of those at one instant."""
    rng = np.random.default_rng(11)
    t0 = dt.datetime(2024, 3, 1)
    left, right = [], []
    for i in range(n):
        hot = i % 3 == 0
        key = "hot" if hot else f"k{rng.integers(40)}"
        at = t0 + dt.timedelta(seconds=int(rng.integers(86_400))) if hot else t0 + dt.timedelta(seconds=int(rng.integers(-20 * 86_400, 20 * 86_400)))
        if hot and rng.random() < 1 / 3:
            at = t0 + dt.timedelta(hours=13)
        (right if rng.random() < 0.3 else left).append((key, at, i))
    left += [("hot", None, -1), (None, t0, -2)]
    right += [("hot", None, -3)]
    return (spark.createDataFrame(left, "k string, at timestamp, i int"), spark.createDataFrame(right, "k string, seen timestamp, v int"), left, right)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_join_of_a_crowded_key_and_day(spark, direction, exact):
    ldf, rdf, left, right = crowded_line(spark)
    got = {r.i: (r.asof_seen, r.v) for r in tj.asof_join(ldf, rdf, ["k"], "at", "seen", ["v"], direction, exact, crowded=150).collect()}
    assert len(got) == len(left)
    line = {}
    for k, at, v in right:
        if at is not None:
            line.setdefault(k, []).append((at, v))
    for k, at, i in left:
        rows = [] if at is None else [r for r in line.get(k, []) if (r[0] <= at if direction == "backward" else r[0] >= at) and (exact or r[0] != at)]
        want = (max if direction == "backward" else min)(rows, default=(None, None))
        assert got[i] == want, (k, at, i)


def test_crowded_buckets_are_cut_evenly(spark):
    ldf, rdf, left, right = crowded_line(spark, 24_000)
    line = ldf.select("k", F.col("at").alias("_ts")).where("_ts IS NOT NULL")
    cut = tj.time_buckets(line, ["k"], crowded=300).withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.col("_copies")))
    sizes = cut.where("k = 'hot'").groupBy("_b", "_sub", "_copy").count().toPandas()["count"]
    assert sizes.sum() > 5000 and len(sizes) > 12 and sizes.max() <= 3 * sizes.median()
    cold = cut.where("k <> 'hot'").agg(F.max("_sub"), F.max("_copies")).first()
    assert tuple(cold) == (0, 1)


def test_document_windows_of_a_crowded_symbol(spark):
    _, _, left, right = crowded_line(spark, 3000)
    docs = [(k, at, float(i % 7)) for k, at, i in left if at is not None] + [("hot", dt.datetime(2024, 3, 1, 13), None)]
    bars = sorted({(k, at, 1.0) for k, at, _ in right if at is not None} | {("hot", dt.datetime(2024, 3, 1, 13), 1.0), ("none", dt.datetime(2024, 3, 1), 1.0)}, key=str)
    ddf = spark.createDataFrame(docs, "symbol string, published_at timestamp, sentiment_score double")
    bdf = spark.createDataFrame(bars, "symbol string, ts timestamp, close double")
    for crowded in (100, 1_000_000):
        got = {(r.symbol, r.ts): (r.doc_count, r.sentiment_score) for r in tj.document_windows(ddf, bdf, 3, crowded=crowded).collect()}
        assert len(got) == len(bars)
        for k, at, _ in bars:
            x = [s for d, p, s in docs if d == k and s is not None and at - dt.timedelta(days=3) <= p < at]
            n, mean = got[k, at]
            assert n == len(x) and mean == pytest.approx(np.mean(x) if x else 0.0, abs=1e-9)


def test_business_days_match_numpy(spark):
    days = [DAY0 + dt.timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for lag in (0, 1, 2, 5, 7, 11):
        for r in df.select("d", dates.shift_bdays(F.col("d"), lag).alias("f"), dates.shift_bdays_back(F.col("d"), lag).alias("b")).collect():
            assert np.datetime64(r.f) == np.busday_offset(r.d, lag, roll="forward")
            assert np.datetime64(r.b) == np.busday_offset(r.d, -lag, roll="backward")


def stepwise(n, wf):
    out, s = [], wf.train
    while s + wf.test <= n:
        train = [i for i in range(s - wf.train, s) if not (wf.horizon > 0 and i + wf.horizon >= s)]
        train = train[: len(train) - wf.embargo] if wf.embargo < len(train) else []
        out.append((train, list(range(s, s + wf.test))))
        s += wf.step
    return out


@pytest.mark.parametrize("wf", [spl.WalkForward(20, 5, 5, 2, 3), spl.WalkForward(10, 4, 3, 0, 0), spl.WalkForward(8, 6, 2, 1, 1),
                                spl.WalkForward(6, 3, 4, 4, 2), spl.WalkForward(5, 5, 5, 3, 3)])
def test_folds_match_the_stepwise_rule(spark, wf):
    n = 47
    rows = spark.range(n).select(F.lit("A").alias("symbol"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,id)").alias("ts"))
    got = spl.assign_folds(spl.with_positions(rows), wf).select("fold", "role", "pos").collect()
    want = {(k, role, p) for k, (tr, te) in enumerate(stepwise(n, wf)) if tr for role, ps in (("train", tr), ("test", te)) for p in ps}
    have = {(r.fold, r.role, r.pos) for r in got}
    if wf.train <= wf.gap:
        assert have == set()
    else:
        assert have == want
    train_max = {}
    for f, role, p in have:
        if role == "train":
            train_max[f] = max(train_max.get(f, -1), p)
    assert all(p + wf.horizon < wf.train + f * wf.step for f, p in train_max.items())  # no overlap with the test window


def test_no_look_ahead_features(spark):
    """Features at a cut equal features built from the history up to the cut."""
    from tidemark.operators.features import build_features

    rng = np.random.default_rng(0)
    idx = pd.bdate_range("2023-01-02", periods=90)
    rows = [("A", t.to_pydatetime(), *[float(p)] * 4, 1e6) for t, p in zip(idx, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90))))]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    cut = str(idx[70].date())
    a = build_features(bars, start="2023-01-01", end="2023-12-31").where(F.col("ts") == cut).first()
    b = build_features(bars, start="2023-01-01", end="2023-12-31", asof=cut).where(F.col("ts") == cut).first()
    assert a == b and a.vol_63d is not None


def test_aligned_series_keep_rows_and_missing_columns_are_named(spark):
    """Rows without a value stay, a key held twice repeats no row, clashing names are refused; a set's
    gaps are found for columns with too few values and for columns that are not there."""
    from tidemark.operators.ranks import importance_ranks
    from tidemark.sources.checks import missing_set_columns

    rows = spark.createDataFrame([("A", 1, 0.5), ("A", 1, 0.5), ("A", 2, 0.1), (None, 1, 0.2)], "symbol string, ts int, y_pred double")
    series = spark.createDataFrame([("A", 1, 7.0), ("A", 1, 9.0), ("B", 1, 3.0)], "symbol string, ts int, v double")
    got = sorted(map(tuple, tj.align_series(rows, series).collect()), key=str)
    assert got == sorted([("A", 1, 0.5, 9.0), ("A", 1, 0.5, 9.0), ("A", 2, 0.1, None), (None, 1, 0.2, None)], key=str)
    with pytest.raises(ValueError, match="y_pred"):
        tj.align_series(rows, series.withColumnRenamed("v", "y_pred"))
    f = spark.createDataFrame([("A", 1.0, 1.0, 1.0), ("A", 2.0, None, -1.0), ("B", 3.0, None, 1.0)], "symbol string, x double, z double, y double")
    gaps = {tuple(r) for r in missing_set_columns(f, {"s": ["x", "z"], "t": ["x", "w"]}).collect()}
    assert gaps == {("s", "B", "z", 0), ("t", "A", "w", 0), ("t", "B", "w", 0)}
    assert missing_set_columns(f.limit(0), {"s": ["x"]}).count() == 0
    ranked = {(r.symbol, r.feature): (r.importance, r["rank"]) for r in importance_ranks(f, ["x", "z"], "y").collect()}
    assert ranked == {("A", "x"): (1, 1.5), ("A", "z"): (1, 1.5), ("B", "x"): (1, 1.0), ("B", "z"): (0, 2.0)}


def test_moving_frames_of_chunks_equal_windows(spark, monkeypatch):
    """Long frames taken over chunks of whole groups, against windows: gaps, short groups, cuts at many places."""
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from tidemark.operators import windows as win

    monkeypatch.setattr(win, "CHUNK", 64)
    rnd = random.Random(8)
    rows = [(f"S{g}" if g else None, dt.datetime(2000, 1, 1) + dt.timedelta(k), None if rnd.random() < 0.01 else (7.0 if g == 3 else rnd.uniform(1, 9)))
            for g in range(30) for k in range(rnd.choice((1, 20, 21, 70, 150)))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double").repartition(3)
    new = win.in_blocks(df, {"x": ("x", (14, 63))}, {"x": (21, 63)})
    old = df.withColumns({"_sum_x_14": win.rolling_sum("x", 14), "_sum_x_63": win.rolling_sum("x", 63),
                          "_std_x_21": win.rolling_std("x", 21), "_std_x_63": win.rolling_std("x", 63)})
    got, want = ({(r.symbol, r.ts): r for r in d.collect()} for d in (new, old))
    assert got.keys() == want.keys() and sum(r._std_x_63 is not None for r in want.values()) > 100
    for k, r in want.items():
        for c in new.columns[2:]:
            assert (got[k][c] is None) == (r[c] is None)
            assert r[c] is None or abs(got[k][c] - r[c]) <= 1e-11 * max(1.0, abs(r[c]))
    assert {got[k]._std_x_21 for k in got if k[0] == "S3"} <= {None, 0.0}
    assert "MapInArrow" in new._jdf.queryExecution().optimizedPlan().toString()
