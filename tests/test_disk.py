"""What queries move and keep on disk: rows are shuffled as few times and as narrow as they can be, and shuffles are given back."""
import dataclasses
import datetime as dt
import glob
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES = entry.queries()
SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}


def moved(df):
    """The text of the shuffles in a plan, with the rows they move."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_written_tables_give_their_shuffles_back(spark):
    from tidemark.sources.lake import materialized

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, had = shuffle_files(spark), spark.conf.get(key)
    out = materialized(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):
        if not shuffle_files(spark) - held:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - held
    assert out.count() == 100 and spark.conf.get(key) == had


def test_feature_rows_are_moved_by_symbol_and_by_day_only(spark):
    """No join on (symbol, ts) moves whole feature rows, and what follows from the day or the row is not moved by day."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with tables too large for it
    try:
        shuffles = moved(QUERIES["fea_33_build_features"](spark, SMALL))
    finally:
        spark.conf.set(key, had)
    assert not [s for s in shuffles if "hashpartitioning(symbol#" in s and ", ts#" in s]
    assert len([s for s in shuffles if "hashpartitioning(ts#" in s]) == 1


def test_documents_beside_bars_are_those_of_the_windows(spark):
    """Repeated bars, days without scores, bars without symbol or time, a symbol without documents."""
    from tidemark.operators.timejoin import document_windows, with_daily_documents

    rng = random.Random(5)
    docs = [(rng.choice(["A", "B", None]), None if i % 50 == 0 else T0 + dt.timedelta(hours=rng.randrange(24 * 120)), None if i % 7 == 0 else rng.uniform(-1, 1)) for i in range(400)]
    bars = [(s, T0 + dt.timedelta(d), float(d)) for s in ("A", "B", "C", None) for d in range(0, 150, 3)] + [("A", T0, -1.0), ("A", None, 5.0), (None, None, 6.0)]
    ddf = spark.createDataFrame(docs, "symbol string, published_at timestamp, sentiment_score double")
    bdf = spark.createDataFrame(bars, "symbol string, ts timestamp, close double")
    rows = lambda df: sorted(map(repr, ((r.symbol, r.ts, r.close, None if r.sentiment_score is None else round(r.sentiment_score, 9), r.doc_count, r.has_coverage) for r in df.collect())))
    for back in (30, 1):
        windows = document_windows(ddf, bdf.select("symbol", F.to_date("ts").alias("ts")), back).withColumn("ts", F.col("ts").cast("timestamp"))
        assert rows(with_daily_documents(bdf, ddf, back)) == rows(bdf.join(windows, ["symbol", "ts"], "left"))
    with pytest.raises(ValueError):
        with_daily_documents(bdf, ddf, 0)


def test_a_days_pieces_put_together_are_the_whole():
    """Rows in any order, days without values, missing days, infinite values: chunk after chunk gives what one chunk gives."""
    import numpy as np
    import pyarrow as pa

    from tidemark.operators import monitor as mon

    rng = np.random.default_rng(8)
    x = np.where(rng.random((3000, 2)) < 0.3, np.nan, rng.normal(5, 3, (3000, 2)))
    day = rng.integers(0, 40, 3000)
    x[day == 7, 0] = np.nan
    x[np.flatnonzero(day == 9)[0], 1] = np.inf
    table = pa.table({"day": pa.array(day, pa.int32(), mask=day == 3), "_x0": x[:, 0], "_x1": x[:, 1]})
    whole = mon._by_day(table, 2)
    cuts, together = [0, 1, 700, 701, 2000, 3000], None
    for a, b in zip(cuts, cuts[1:]):
        piece = mon._by_day(table.slice(a, b - a), 2)
        together = piece if together is None else mon._put_together(together, piece)
    for one, other in zip(whole, together):
        np.testing.assert_allclose(other, one, rtol=1e-10)


def test_drift_of_columns_in_several_tables(spark):
    """A panel in two tables of the same rows, in other orders, gives what one table gives."""
    from tidemark.operators import monitor as mon

    rng = random.Random(9)
    rows = [(f"s{s}", T0 + dt.timedelta(d), rng.gauss(0, 1), None if d % 5 else rng.gauss(d, 1), rng.gauss(0, 1 + d // 60)) for d in range(90) for s in range(8)]
    whole = spark.createDataFrame(rows, "symbol string, ts timestamp, a double, b double, c double")
    parts = [whole.orderBy("symbol", "ts").select("ts", "a", "c"), whole.select("ts", "b")]
    for run in (lambda p: mon.drift_psi(p, ["a", "b", "c"], recent=20), lambda p: mon.feature_stats(p, ["a", "b", "c"], recent=20)):
        one, two = ({r.feature: r.asDict() for r in run(p).collect()} for p in (whole, parts))
        assert set(one) == set(two) == set("abc")
        for c in "abc":
            for k, v in one[c].items():
                assert two[c][k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), (c, k)
    with pytest.raises(ValueError):
        mon.drift_psi(parts, ["a", "nowhere"])


def test_monitored_rows_are_not_moved_by_day(spark):
    """Only the ranked columns are moved by day; a reading of the written columns moves no row of theirs."""
    from tidemark.plans.desk_q import DRIFT, monitored
    from tidemark.sources.derive import Tables

    key = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        own, ranks = monitored(Tables(spark, SMALL))
        assert not [s for s in moved(own) if "ts#" in s or "symbol#" in s]
    finally:
        spark.conf.set(key, had)
    assert set(own.columns) | set(ranks.columns) >= set(DRIFT) and all(c == "ts" or c.startswith("xs_rank_") for c in ranks.columns)
    assert own.count() == ranks.count()


def test_label_schemes_multiply_no_rows(spark, monkeypatch):
    """Forecasts of all schemes against one ridge run each; written is a row per scheme and date, not per scheme and bar."""
    import numpy as np

    from tidemark.operators import models as mod
    from tidemark.operators import panel as pan
    from tidemark.operators import splits as spl

    rng = random.Random(11)
    gap = lambda x, p: None if rng.random() < p else float("nan") if rng.random() < p else x
    rows = [(f"s{s}", T0 + dt.timedelta(d), rng.gauss(0, 1), gap(rng.gauss(0, 1), 0.02), gap(rng.gauss(0, 1), 0.02), gap(rng.gauss(0, 1), 0.02), gap(rng.gauss(0, 1), 0.1) if d > 4 else None)
            for d in range(120) for s in range(12)]
    f = spark.createDataFrame(rows, "symbol string, ts timestamp, earned double, a double, b double, y1 double, y2 double")
    wf = spl.WalkForward(train=40, test=20, step=20, embargo=2, horizon=1)
    schemes = {"one": pan.LabelScheme(lambda: F.col("y1"), 1), "two": pan.LabelScheme(lambda: F.col("y2") * 2, 5)}
    written, write = [], pan.materialized
    monkeypatch.setattr(pan, "materialized", lambda df: written.append(df.count()) or write(df))
    out = pan.label_ablation(f, schemes, ["a", "b"], wf)
    got = {(r.run, r.fold, r.symbol, r.ts): (r.y_true, r.y_pred, r.earned) for r in out.collect()}
    assert max(written) <= len(schemes) * 120
    want = {}
    for name, s in schemes.items():
        one = spl.with_positions(f.withColumn("y", s.label()).dropna(subset=["y", "a", "b"]))
        fits = mod.ridge_fits(one, dataclasses.replace(wf, horizon=s.horizon), ["a", "b"])
        test = spl.assign_folds(one, wf, ("test",)).join(fits.select("fold", "beta"), "fold").withColumn("p", mod.linear_score(["a", "b"]))
        want |= {(name, r.fold, r.symbol, r.ts): (r.y, r.p, r.earned) for r in test.collect()}
    assert set(got) == set(want) and len({k[:2] for k in got}) == 4 + 3
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-9)
