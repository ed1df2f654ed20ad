"""Replay, ranks, statistics and lake behaviour against plain Python."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import features as feat
from tidemark.operators import labels as lab
from tidemark.operators import metrics as met
from tidemark.operators import panel as pan
from tidemark.operators import ranks
from tidemark.operators import regimes as reg
from tidemark.operators import replay as rep
from tidemark.operators import stats as st
from tidemark.operators.splits import WalkForward, with_positions
from tidemark.sources.lake import Lake, keep_latest

T0 = dt.datetime(2024, 1, 1)


def plain_replay(opens, vols, sig, fee, bps, cap, cash=100_000.0):
    slip, pos, entry, eq, pnl = bps / 1e4, 0, 0.0, [], []

    def close(price):
        nonlocal cash, pos
        fill = price * (1 - slip * np.sign(pos))
        cash += pos * fill - abs(pos) * fee
        pnl.append(pos * (fill - entry) - 2 * abs(pos) * fee)
        pos = 0

    for t, price in enumerate(opens):
        if t and sig[t - 1] != np.sign(pos):
            if pos:
                close(price)
            if sig[t - 1]:
                fill = price * (1 + slip * sig[t - 1])
                n = max(0, min(int(cash / fill), int(vols[t] * cap)))
                if n:
                    cash -= n * sig[t - 1] * fill + n * fee
                    pos, entry = n * sig[t - 1], fill
        eq.append(cash + pos * price)
    if pos:
        close(opens[-1])
        eq[-1] = cash
    return eq, pnl


def bars_of(spark, groups):
    rows = [(g, T0 + dt.timedelta(days=i), float(o), float(v), int(s)) for g, (os, vs, ss) in groups.items() for i, (o, v, s) in enumerate(zip(os, vs, ss))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, volume double, signal int")


def test_replay_matches_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    groups = {f"g{i}": (100 * np.exp(np.cumsum(rng.normal(0, 0.03, n))), rng.integers(0, 30_000, n).astype(float), rng.integers(-1, 2, n))
              for i, n in enumerate([1, 2, 5, 60, 60, 90])}
    costs = rep.Costs(0.01, 7.0, 0.1)
    got = rep.replay(bars_of(spark, groups), ["symbol"], costs).collect()
    for r in got:
        eq, pnl = plain_replay(*groups[r.symbol], 0.01, 7.0, 0.1)
        assert [e.equity for e in r.eq] == pytest.approx(eq, rel=1e-12)
        assert [x.net_pnl for x in r.trades] == pytest.approx(pnl, rel=1e-9, abs=1e-6)


def test_replay_layers_equal_rows_laid_out_before(spark, monkeypatch):
    """Folds and cost sets laid over a symbol's bars, in chunks that cut the table at many places."""
    monkeypatch.setattr(rep, "CHUNK", 40)
    rng = np.random.default_rng(4)
    groups = {f"g{i}": (100 * np.exp(np.cumsum(rng.normal(0, 0.03, n))), rng.integers(0, 30_000, n).astype(float), rng.integers(-1, 2, n))
              for i, n in enumerate(rng.integers(1, 60, 25))}
    bars = bars_of(spark, groups).withColumn("day", F.dayofyear("ts"))
    runs = F.array(*[F.struct(F.lit(i).alias("step"), (F.col("day") % 7).alias("fold"), F.lit(fee).alias("commission_per_share"),
                              F.lit(7.0).alias("slippage_bps"), F.lit(0.1).alias("liquidity_cap")) for i, fee in enumerate((0.01, 0.0))])
    by = ["step", "symbol", "fold"]
    layered = bars.withColumn("runs", F.filter(runs, lambda c: (c["step"] == 0) | (F.col("day") > 5)))
    laid = layered.withColumn("_r", F.explode("runs")).select("symbol", "ts", "open", "volume", "signal", "_r.*")
    got = {tuple(r[c] for c in by): (r.eq, r.trades) for r in rep.replay(layered, by, layers="runs").collect()}
    want = {tuple(r[c] for c in by): (r.eq, r.trades) for r in rep.replay(laid, by).collect()}
    assert len(want) > 200 and got == want


def test_missing_signals_keep_the_position_and_missing_volume_does_not_limit(spark):
    rows = [("a", T0 + dt.timedelta(days=i), o, v, s) for i, (o, v, s) in enumerate([
        (100.0, 50.0, 1), (100.0, None, None), (110.0, 50.0, None), (120.0, 50.0, 0), (130.0, 50.0, None)])]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, volume double, signal int")
    r = rep.replay(bars, ["symbol"], rep.Costs(0.0, 0.0, 0.1)).collect()[0]
    assert [e.equity for e in r.eq] == [100_000.0, 100_000.0, 110_000.0, 120_000.0, 130_000.0]
    assert [(t.shares, t.exit_price, t.net_pnl) for t in r.trades] == [(1000, 130.0, 30_000.0)]


def test_cost_sets_do_not_multiply_the_moved_rows(spark):
    """Bars are shuffled and sorted once, whatever the number of cost sets."""
    bars = bars_of(spark, {"g": ([100.0, 101.0], [9e3, 9e3], [1, 0])})
    plan = rep.cost_decomposition(bars, rep.BACKTEST_COSTS, rep.Costs(0.0, 2.0, 0.1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_foresight_and_noise(spark):
    rng = np.random.default_rng(3)
    ret = rng.normal(0.0005, 0.015, 500)
    px = 100 * np.exp(np.cumsum(ret))
    ahead = np.sign(np.append(px[2:] / px[1:-1] - 1, [0, 0])).astype(int)
    noise = rng.integers(-1, 2, 500)
    vol = np.full(500, 5e6)
    r = rep.replay_returns(bars_of(spark, {"ahead": (px, vol, ahead), "noise": (px, vol, noise)}), ["symbol"], rep.BACKTEST_COSTS)
    s = {x.symbol: x.s for x in r.groupBy("symbol").agg(met.sharpe("ret").alias("s")).collect()}
    assert s["ahead"] > 2 and -2.5 < s["noise"] < 1.5


def test_percent_rank_with_ties_and_gaps(spark):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"symbol": [f"s{i}" for i in range(n)] * 2, "ts": [T0] * n + [T0 + dt.timedelta(days=1)] * n,
                        "x": np.where(rng.random(2 * n) < 0.1, np.nan, np.where(rng.random(2 * n) < 0.35, 0.0, rng.normal(size=2 * n).round(2)))})
    sdf = spark.createDataFrame([(a, b.to_pydatetime(), None if math.isnan(c) else float(c)) for a, b, c in pdf.itertuples(index=False)], "symbol string, ts timestamp, x double")
    got = ranks.percent_rank_columns(sdf, ["x"]).toPandas().set_index(["symbol", "ts"])["xs_rank_x"]
    want = pdf.assign(r=pdf.groupby("ts")["x"].rank(pct=True)).set_index(["symbol", "ts"])["r"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


@pytest.mark.parametrize("crowded", [40, 200_000])
def test_percent_ranks_of_crowded_days(spark, crowded):
    """One day holds most rows, one value a third of them; NULLs and NaN-free ties count alike."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        day = T0 if i % 3 else T0 + dt.timedelta(days=int(rng.integers(1, 9)))
        x = None if rng.random() < 0.1 else 7.0 if rng.random() < 0.35 else float(rng.integers(0, 60))
        rows.append((f"s{i}", day, x, None if rng.random() < 0.3 else float(rng.normal())))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, z double")
    got = ranks.percent_rank_columns(df.repartition(5), ["x", "z"], crowded=crowded).toPandas().set_index("symbol")
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "x", "z"]).set_index("symbol")
    for c in ("x", "z"):
        want = pdf.groupby("ts")[c].rank(pct=True)
        want[pdf.groupby("ts")[c].transform("count") < 5] = np.nan
        pd.testing.assert_series_equal(got[f"xs_rank_{c}"].sort_index(), want.sort_index(), check_names=False)
    assert ranks.percent_rank_columns(df.limit(0), ["x"]).count() == 0


def test_monitoring_of_made_columns(spark):
    """Stable, drifting, shape-shifting, stale, empty and constant columns against numpy."""
    from tidemark.operators import monitor as mon

    rng = np.random.default_rng(12)
    rows, n_days = [], 80
    for d in range(n_days):
        for s in range(6):
            late = d >= n_days - 20
            rows.append((f"s{s}", T0 + dt.timedelta(days=d), float(rng.normal()), float(rng.normal() + 5 * late), float(rng.normal() * (4 if late else 1)),
                         float(rng.normal()) if d < 40 else None, None, 3.0, float(rng.integers(-1, 2)), float("nan") if s == 0 else -0.0))
    cols = ["stable", "drift", "shape", "stale", "empty", "flat", "signs", "gaps"]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in cols))
    got = {r.feature: r for r in mon.feature_stats(df, cols, recent=20, stale_bars=21).collect()}
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", *cols])
    assert {c: got[c].verdict for c in cols} == {"stable": "stable", "drift": "drifting", "shape": "drifting", "stale": "stale", "empty": "stale",
                                                  "flat": "stable", "signs": "stable", "gaps": "stable"}
    for c in cols:
        v = pdf[c].dropna().astype(float)
        assert got[c].n_rows == len(pdf) and got[c].coverage == pytest.approx(len(v) / len(pdf))
        if not len(v):
            assert got[c].mean is None and got[c].std is None and got[c].distribution is None and got[c].psi is None
            continue
        assert got[c].mean == pytest.approx(v.mean(), abs=1e-12) and got[c].std == pytest.approx(v.std(), abs=1e-12)
        if v.min() < v.max():
            assert sum(got[c].distribution) == len(v) and list(got[c].distribution) == list(np.histogram(v, 20)[0])
        else:
            assert got[c].distribution[10] == len(v)
        days = sorted(pdf[pdf[c].notna()].ts.unique())
        recent = pdf.ts.isin(days[-20:])
        base, new = pdf[c][~recent].dropna(), pdf[c][recent].dropna()
        edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
        if len(edges) < 2 or len(days) <= 21:
            assert got[c].psi is None
            continue
        place = lambda x: np.bincount(np.clip(np.searchsorted(edges[1:-1], x, "right"), 0, len(edges) - 2), minlength=len(edges) - 1) / len(x)
        a, b = (np.where(p == 0, 1e-4, p) for p in (place(new), place(base)))
        assert got[c].psi == pytest.approx(((a - b) * np.log(a / b)).sum(), abs=1e-9), c
    assert mon.feature_stats(df.limit(0), cols).count() == 0 and mon.drift_psi(df.limit(0), cols).count() == 0


def test_shift_match_finds_a_shifted_build(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60).round(1)
    rows = [(k, T0 + dt.timedelta(days=i), float(x[i]), float(x[max(i - 1, 0)]), float(x[max(i - 3, 0)])) for k in "AB" for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, same double, one double, three double")
    b = df.select("symbol", "ts", *[F.col("same").alias(c) for c in ("same", "one", "three")])
    got = {r.feature: (r.best_lag, r.match_share) for r in pan.shift_match(df, b, ["same", "one", "three"], ["symbol"]).collect()}
    assert got == {"same": (0, 1.0), "one": (1, 1.0), "three": (3, 1.0)}


def test_shuffled_columns_stay_in_their_window(spark):
    rng = np.random.default_rng(4)
    rows = [(0, f, s, T0 + dt.timedelta(days=i), float(v), float(rng.normal()), [0.0, 2.0, 0.0]) for f in (0, 1) for s in "AB" for i, v in enumerate(rng.normal(size=9))]
    df = spark.createDataFrame(rows, "run int, fold int, symbol string, ts timestamp, a double, y_true double, beta array<double>")
    df = df.withColumns({"b": F.lit(1.0), "y_pred": 2 * F.col("a")})
    got = pan.permuted_predictions(df, ["a", "b"], ["a"], 3, seed=1).toPandas()
    assert len(got) == 3 * len(rows)
    for (f, s, k), part in got.groupby(["fold", "symbol", "repeat"]):
        own = sorted(r[4] for r in rows if r[1] == f and r[2] == s)
        assert np.allclose(sorted(part.y_pred / 2), own)
    assert got.groupby("repeat").y_pred.apply(lambda x: tuple(x.round(9))).nunique() == 3


def test_total_order_at_the_sink(spark, tmp_path):
    rows = [(i % 7, f"v{(i * 37) % 100:02}", i) for i in range(500)] + [(None, None, -1), (3, "v01", 9), (3, "v01", 9)]
    df = spark.createDataFrame(rows, "k int, s string, i int")
    lake = Lake(spark, str(tmp_path))
    lake.write_ordered(df.repartition(6), "a", ["k", "s"])
    lake.write_ordered(df.repartition(3), "b", ["k", "s"])
    a, b = ([tuple(r) for r in lake.read(n).orderBy("position").collect()] for n in "ab")
    assert a == b and [r[3] for r in a] == list(range(len(rows)))
    assert [r[:3] for r in a] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2]))
    lake.write_ordered(df.limit(0), "none", ["k"])
    assert lake.read("none").count() == 0


def test_injected_sources_must_have_their_columns(spark):
    from tidemark.sources.derive import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    same = t.with_sources(bars=lambda x: Tables(x.spark, x.dir).bars().where("symbol = 'S1'"))
    assert {r.symbol for r in same.bars().select("symbol").distinct().collect()} == {"S1"} and t.bars().select("symbol").distinct().count() > 1
    assert {r.run for r in same.returns().select("run").distinct().collect()} == {"S1"}
    with pytest.raises(ValueError, match="lacks"):
        t.with_sources(bars=lambda x: x.raw("orders")).bars()
    with pytest.raises(ValueError, match="no such source"):
        t.with_sources(prices=lambda x: x.raw("orders"))


def test_luck_bar_grows_with_trials(spark):
    from tidemark.operators import reports as rpt

    rows = [("a", i, 1, float(s)) for i, s in enumerate([0.1, 0.5, -0.2, 0.9, 0.3])] + [("b", 0, 4, 0.2)]
    out = rpt.luck_bar(spark.createDataFrame(rows, "agent string, id int, n_comparisons int, sharpe double"), ["agent"], ["id"]).orderBy("agent", "id").collect()
    assert [r.n_trials for r in out] == [1, 2, 3, 4, 5, 4] and [r.best_sharpe for r in out] == [0.1, 0.5, 0.5, 0.9, 0.9, 0.2]
    assert out[0].luck_bar is None and not out[0].beats_luck and out[5].luck_bar is None
    from statistics import NormalDist, stdev

    g, z = 0.5772156649015329, NormalDist().inv_cdf
    want = stdev([0.1, 0.5, -0.2, 0.9]) * ((1 - g) * z(1 - 1 / 4) + g * z(1 - 1 / (4 * math.e)))
    assert out[3].luck_bar == pytest.approx(want) and out[3].beats_luck == (0.9 > want)


def test_auc_spearman_quantiles(spark):
    rng = np.random.default_rng(4)
    p, y = rng.normal(size=500).round(1), rng.integers(0, 2, 500)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(p, y)], "g string, y_pred double, y_true int")
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert ranks.roc_auc(df, ["g"]).first().auc == pytest.approx(wins)
    one = df.where("y_true = 1")
    assert ranks.roc_auc(one, ["g"]).first().auc is None
    rho = np.corrcoef(pd.Series(p).rank(), pd.Series(y).rank())[0, 1]
    assert ranks.spearman(df, ["g"], "y_pred", "y_true").first().rho == pytest.approx(rho)
    cuts = [0, 0.1, 0.37, 0.5, 0.99, 1]
    assert ranks.exact_quantiles(df, ["g"], "y_pred", cuts).first().q == pytest.approx(list(np.quantile(p, cuts)))


def test_diebold_mariano_and_degenerate_inputs(spark):
    rng = np.random.default_rng(6)
    a, b, h = rng.normal(size=100), rng.normal(size=100) * 1.3, 4
    d = a**2 - b**2
    n, e = 100, d - d.mean()
    g = [np.mean(e * e)] + [np.mean(e[j:] * e[:-j]) for j in range(1, h)]
    stat = d.mean() / np.sqrt((g[0] + 2 * sum((1 - j / h) * g[j] for j in range(1, h))) / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    rows = [("x", T0 + dt.timedelta(days=i), float(u), float(v)) for i, (u, v) in enumerate(zip(a, b))]
    rows += [("same", T0 + dt.timedelta(days=i), 1.0, 1.0) for i in range(10)] + [("short", T0 + dt.timedelta(days=i), 1.0, 2.0 + i) for i in range(3)]
    out = {r.g: r for r in st.diebold_mariano(spark.createDataFrame(rows, "g string, ts timestamp, err_a double, err_b double"), ["g"], h=h).collect()}
    assert out["x"].statistic == pytest.approx(stat) and out["x"].p_value == pytest.approx(special.student_t_cdf(stat, 99))
    assert out["same"].statistic is None and out["short"].p_value is None


def test_distribution_functions():
    assert special.student_t_cdf(2.228138852, 10) == pytest.approx(0.975, abs=1e-9)
    assert special.student_t_cdf(-1.0, 1) == pytest.approx(0.25, abs=1e-12)


def test_skill_z_without_spread(spark):
    df = spark.createDataFrame([("up", 1.0)] * 3 + [("down", -1.0)] * 3 + [("zero", 0.0)] * 3, "g string, skill double")
    z = {r.g: r.z for r in st.skill_z(df, ["g"]).collect()}
    assert z == {"up": math.inf, "down": -math.inf, "zero": 0.0}


def test_bootstrap_blocks_are_contiguous_and_repeatable(spark):
    df = spark.range(60).select(F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int))").alias("ts"))
    a = st.block_positions(df, [], 5, block_len=10).toPandas().sort_values(["replicate", "i"])
    b = st.block_positions(df.repartition(7), [], 5, block_len=10).toPandas().sort_values(["replicate", "i"])
    assert (a.pos.values == b.pos.values).all() and a.pos.between(0, 59).all()
    step = a.groupby("replicate").pos.diff().dropna()
    assert (step.isin([1, -59])).mean() > 0.75


def test_replicates_from_prefix_sums_equal_resampled_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(g, T0 + dt.timedelta(days=i), float(a), float(b)) for g, n in (("a", 90), ("b", 7), ("c", 1), ("flat", 30))
            for i, (a, b) in enumerate(rng.normal(0.01, 0.1, (n, 2)) if g != "flat" else np.full((n, 2), 0.1))]
    df = spark.createDataFrame(rows, "g string, ts timestamp, variant double, baseline double")
    for kind in ("stationary", "moving"):
        fast = st.resampled_sums(df, ["g"], ["variant", "baseline"], st.SHARPE, 25, block_len=6, seed=4, kind=kind).toPandas()
        slow = st.resampled(df, ["g"], 25, block_len=6, seed=4, kind=kind).groupBy("g", "replicate").agg(
            F.count(F.lit(1)).alias("n"), met.sharpe("variant").alias("variant"), met.sharpe("baseline").alias("baseline")).toPandas()
        both = fast.merge(slow, on=["g", "replicate"], suffixes=("", "_rows"))
        sizes = {"a": 90, "b": 7, "c": 1, "flat": 30}
        assert len(both) == len(slow) == 100 and all(both.n == both.g.map(sizes))
        moved = both[both.g.isin(["a", "b"])]
        assert np.allclose(moved.variant, moved.variant_rows, rtol=1e-9) and np.allclose(moved.baseline, moved.baseline_rows, rtol=1e-9)
        assert (both[both.g.isin(["c", "flat"])][["variant", "baseline"]] == 0).all().all()
    quick = st.bootstrap_delta_ci(df, ["g"], st.MEAN_ABSOLUTE, n_boot=40, seed=1).orderBy("g").toPandas()
    plain = st.bootstrap_delta_ci(df, ["g"], lambda c: F.avg(F.abs(F.col(c))), n_boot=40, seed=1).orderBy("g").toPandas()
    assert np.allclose(quick[["ci_low", "ci_high"]], plain[["ci_low", "ci_high"]]) and (quick.n_replicates == 40).all()
    assert st.bootstrap_delta_ci(df.limit(0), ["g"]).count() == 0


def test_block_lengths_are_geometric(spark):
    df = spark.range(2000).select(F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int))").alias("ts"))
    p = st.block_positions(df, [], 30, block_len=21).toPandas().sort_values(["replicate", "i"])
    assert (p.groupby("replicate").size() == 2000).all() and (p.groupby("replicate").i.max() == 1999).all()
    breaks = (~p.groupby("replicate").pos.diff().dropna().isin([1, -1999])).mean()
    assert breaks == pytest.approx(1 / 21, rel=0.1)


def test_permutation_p_value_against_all_orders(spark):
    """Five features with a tie: the share of all 120 orders at or above the observed one."""
    import itertools

    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 3.0, 3.0, 2.0, 9.0]
    df = spark.createDataFrame([("g", f"f{i}", x, y) for i, (x, y) in enumerate(zip(a, b))] + [("h", "f0", 1.0, 2.0), ("h", "f1", None, 1.0)],
                               "g string, feature string, a double, b double")
    ra, rb = pd.Series(a).rank(), pd.Series(b).rank()
    rho = np.corrcoef(ra, rb)[0, 1]
    share = np.mean([np.corrcoef(p, rb)[0, 1] >= rho - 1e-12 for p in itertools.permutations(ra)])
    got = {r.g: r for r in st.rank_agreement(df, ["g"], "a", "b", n_permutations=4000).collect()}
    assert got["g"].rho == pytest.approx(rho) and got["g"].p_value == pytest.approx(share, abs=0.03)
    assert got["h"].rho is None and got["h"].n == 1


def test_labels_and_weights(spark):
    px = [100.0 + 0.1 * (i % 3) for i in range(25)] + [130.0, 90.0] + [100.0] * 5
    df = spark.createDataFrame([("A", T0 + dt.timedelta(days=i), p) for i, p in enumerate(px)], "symbol string, ts timestamp, close double")
    tb = [r.y for r in lab.arm_labels(df).where("label_id = 'triple_barrier'").orderBy("ts").collect()]
    assert tb[24] == 1.0 and tb[-5:] == [None] * 5 and tb[0] is None
    n, h = len(px), 5
    raw = [sum(1 / max(1, min(t + j - 1, n - 1) - max(0, t + j - h) + 1) for j in range(1, h + 1)) / h for t in range(n)]
    got = [r.weight for r in lab.sample_weights(df, h).orderBy("ts").collect()]
    assert got == pytest.approx([w / np.mean(raw) for w in raw])


def test_eras_must_not_overlap():
    with pytest.raises(ValueError):
        reg.check_eras([("a", "2020-01-01", "2020-12-31"), ("b", "2020-12-31", "2021-12-31")])


def test_volatility_detector_rejects_unknown_dates(spark):
    vix = spark.createDataFrame([(T0.date(), 12.0)], "day date, value double")
    ok = spark.createDataFrame([(T0,)], "ts timestamp")
    assert reg.tag(ok, reg.vol_detector(vix)).first().regime == "low_vol"
    with pytest.raises(Exception, match="no volatility value"):
        reg.tag(spark.createDataFrame([(T0 + dt.timedelta(days=1),)], "ts timestamp"), reg.vol_detector(vix)).collect()


def test_ridge_sets_share_one_pass(spark):
    """Sub-matrix fits equal direct fits; a column outside a set has no weight."""
    from tidemark.operators.splits import WalkForward, assign_folds, with_positions

    rng = np.random.default_rng(8)
    n = 120
    x = rng.normal(size=(n, 2))
    y = 0.5 * x[:, 0] + rng.normal(size=n) * 0.1
    rows = [("A", T0 + dt.timedelta(days=i), 100.0, 1e6, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    p = with_positions(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, volume double, a double, b double, y double"))
    wf = WalkForward(60, 20, 20, 2, 1)
    fits = {(r.run, r.fold): r.beta for r in pan.ridge_set_fits(p, wf, pan.leave_one_out_sets(["a", "b"])).collect()}
    tr = slice(20, 20 + 60 - 3)  # fold 1
    for name, cols in (("all", [0, 1]), ("all-b", [0])):
        X = x[tr][:, cols]
        Xc, yc = X - X.mean(0), y[tr] - y[tr].mean()
        beta = np.linalg.solve(Xc.T @ Xc + np.eye(len(cols)), Xc.T @ yc)
        got = fits[(name, 1)]
        assert [got[c + 1] for c in cols] == pytest.approx(list(beta))
    assert fits[("all-b", 1)][2] == 0.0
    pred = pan.ridge_set_predictions(p, wf, {"a": ["a"], "b": ["b"]}).where("run = 'a'")
    assert assign_folds(p, wf, ("test",)).count() == pred.count()
    imp = {r.feature: r.importance for r in pan.permutation_importance(pred, ["a", "b"], ["a", "b"], repeats=3).collect()}
    assert abs(imp["b"]) < 1e-9 and abs(imp["a"]) > 1e-3  # b has no weight in this set


def test_sets_side_by_side_return_what_their_rows_do(spark):
    """Returns of all feature sets without a row per set: the bars' calendar, folds and fits are small and broadcast."""
    rng = np.random.default_rng(12)
    rows = [(s, T0 + dt.timedelta(days=i), float(100 + rng.normal()), 1e4, *map(float, rng.normal(size=3)))
            for s in ("A", "B", "C") for i in range(130) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, volume double, a double, b double, y double")
    sets = pan.add_one_sets(["a"], ["b"])
    for wf in (WalkForward(50, 20, 20, 2, 1), WalkForward(50, 20, 10, 2, 1)):  # the second's test windows overlap
        p = with_positions(df)
        pred = pan.ridge_set_predictions(p, wf, sets).withColumn("signal", rep.sign_signal("y_pred"))
        want = rep.cross_section_mean(rep.replay_returns(pred, ["run", "fold", "symbol"], rep.BACKTEST_COSTS), ["run", "fold"]).toPandas()
        for got in (pan.ridge_set_returns(p, wf, sets), pan.portfolio_returns(pred)):
            both = got.toPandas().merge(want, on=["run", "fold", "ts"], how="outer", suffixes=("", "_want"))
            assert len(both) == len(want) > 100 and (both.n_symbols == both.n_symbols_want).all()
            assert both.ret.tolist() == pytest.approx(both.ret_want.tolist(), abs=1e-14)
        plan = pan.ridge_set_returns(p, wf, sets)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "explode(eq" not in plan


def test_means_over_symbols_with_missing_values(spark):
    """Two signals side by side, costs in the rows, missing prices and signals, groups of one bar."""
    rng = np.random.default_rng(5)
    rows = [(s, k, T0 + dt.timedelta(days=i), None if rng.random() < 0.1 else float(100 + rng.normal()), None if rng.random() < 0.1 else 1e4,
             None if rng.random() < 0.2 else int(rng.integers(-1, 2)), int(rng.integers(-1, 2)), 0.01 * k, 3.0, 0.1)
            for s in range(30) for k in (0, 1) for i in range(s % 12 + 1)]
    bars = spark.createDataFrame(rows, "symbol int, k int, ts timestamp, open double, volume double, p int, q int, "
                                       "commission_per_share double, slippage_bps double, liquidity_cap double")
    got = rep.mean_returns(bars, ["k"], {"first": "p", "second": "q"}).toPandas()
    for name, column in (("first", "p"), ("second", "q")):
        want = rep.cross_section_mean(rep.replay_returns(bars, ["k", "symbol"], signal=column), ["k"]).toPandas()
        both = got[got.signal == name].merge(want, on=["k", "ts"], how="outer", suffixes=("", "_want"))
        assert len(both) == len(want) > 10 and (both.n_symbols == both.n_symbols_want).all()
        assert both.ret.tolist() == pytest.approx(both.ret_want.tolist(), abs=1e-14)


def test_a_panel_is_not_shuffled_for_its_calendar(spark):
    df = spark.createDataFrame([("A", T0, 1.0)], "symbol string, ts timestamp, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in with_positions(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_some_price_columns_are_the_same_without_the_others(spark):
    rng = np.random.default_rng(4)
    rows = [(s, T0 + dt.timedelta(days=i), *map(float, 100 + rng.normal(size=4)), float(rng.integers(0, 9) * 100)) for s in "AB" for i in range(300)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    whole = feat.price_features(bars).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    for some in [("ret_5d", "vol_21d", "rsi_14"), ("mom_21d",), ("log_volume", "ret_252d"), ("volume_ratio", "ma50_ratio", "vol_63d")]:
        few = feat.price_features(bars, some)
        assert few.columns == [*bars.columns, *some]
        pd.testing.assert_frame_equal(few.toPandas().sort_values(["symbol", "ts"], ignore_index=True), whole[few.columns])
        assert ("_sum_close_200" in few._jdf.queryExecution().analyzed().toString()) is False
    with pytest.raises(ValueError, match="no such price columns"):
        feat.price_features(bars, ["ret_2d"])


def test_feature_sets_are_checked_first(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="unknown columns"):
        pan.check_sets(df, {"s": ["a", "zz"]})


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = [("A", m, 1.0, 1) for m in (1, 2, 3)]
    schema = "symbol string, month int, x double, v int"
    lake.upsert(spark.createDataFrame(rows, schema), "d", ["symbol", "month"], "v", ["month"])
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("month=*/*.parquet")}
    new = spark.createDataFrame([("A", 2, 5.0, 2), ("B", 2, 6.0, 2)], schema)
    for _ in range(2):  # a rerun changes nothing
        lake.upsert(new, "d", ["symbol", "month"], "v", ["month"])
    got = {(r.symbol, r.month): r.x for r in lake.read("d").collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 5.0, ("A", 3): 1.0, ("B", 2): 6.0}
    kept = [p for p in before if "month=2" not in str(p)]
    assert all(p.exists() and p.stat().st_mtime_ns == before[p] for p in kept)


def test_absent_dataset_is_empty(spark, tmp_path):
    assert Lake(spark, str(tmp_path)).read("none", "a int").count() == 0
    assert Lake(spark, str(tmp_path)).high_water("none", "ts").first().latest is None


def test_keep_latest_breaks_ties_by_content(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 0, "z")], "id string, v int, s string")
    assert keep_latest(df, ["id"], "v").first().s == "b"


def test_draws_told_from_digits_equal_those_of_numbers(spark):
    """Also next to the bounds, where a number and its digits could fall apart."""
    parts = (F.lit(9), F.col("id"), F.lit("S1|5"))
    got = spark.range(20_000).select(st.poisson_draw(*parts).alias("a"), st.poisson_weight(st.uniform(*parts)).alias("b"))
    assert got.where("a <> b").count() == 0
    assert got.agg(F.max("a")).first()[0] >= 5


def test_forecasts_are_written_once_a_query(spark, monkeypatch):
    from tidemark.plans import stats_q
    from tidemark.sources.derive import Tables

    built = []
    t = Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(t, "bars", lambda real=t.bars: built.append(1) or real())
    a, b = stats_q.paired(t), stats_q.paired(t, "err")
    assert len(built) == 1 and a.count() == b.count() > 0


def test_importance_of_three_stretches_from_one_pass(spark):
    from tidemark.plans import stats_q
    from tidemark.sources.derive import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    cols = lambda df, *names: {r.feature: tuple(r[n] for n in names) for r in df.collect()}
    both = cols(stats_q.importance_views(t, again="1998-01-01"), "a", "b", "c")
    early, late = cols(stats_q.importance_views(t, split="1998-01-01"), "a"), cols(stats_q.importance_views(t), "a", "b")
    for f, (a, b, c) in both.items():
        assert (a, b) == pytest.approx(late[f], rel=1e-9) and c == pytest.approx(early[f][0], rel=1e-9)
