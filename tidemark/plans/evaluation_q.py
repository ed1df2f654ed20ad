"""Labels, folds, regimes, metrics and replay queries."""
from pyspark.sql import functions as F

from tidemark.operators import reports as rpt
from tidemark.operators import features as feat
from tidemark.operators import labels as lab
from tidemark.operators import metrics as met
from tidemark.operators import regimes as reg
from tidemark.operators import replay as rep
from tidemark.operators import splits as spl
from tidemark.operators import windows as win
from tidemark.plans.oracle_ctes import gated
from tidemark.plans.registry import query, r6
from tidemark.plans.sql_parts import DIGITS, METRIC_NAMES, fold_ctes, metrics_sql, replay_ctes
from tidemark.sources.lake import materialized

START, END = "1995-01-01", "2001-12-31"
ERAS = (("qe_bull", "1996-07-01", "1998-06-30"), ("covid", "1998-07-01", "1999-12-31"),
        ("rate_cycle", "2000-01-01", "2099-12-31"))
WF = spl.WalkForward(horizon=1)


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


# --- labels ---------------------------------------------------------------------------------
@query("lab_01_forward_return", "SELECT symbol, ts, " + ", ".join(
    r6(f'lead("close", {h}) OVER (PARTITION BY symbol ORDER BY ts) / "close" - 1', f"fwd_{h}") for h in (1, 5, 21)) + " FROM bars")
def _(t):
    return t.bars().select("symbol", "ts", *[r(lab.forward_return(h), f"fwd_{h}") for h in (1, 5, 21)])


_TB = """
CASE WHEN vol > 0 AND c5 IS NOT NULL THEN CASE
  WHEN up IS NULL AND dn IS NULL THEN 0.0 WHEN up = dn THEN 0.0
  WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 1.0 ELSE -1.0 END END"""
_ARM_SRC = f"""
SELECT *, CASE {' '.join(f'WHEN c{k} >= "close" * (1 + 2.0 * vol) THEN {k}' for k in range(1, 6))} END AS up,
          CASE {' '.join(f'WHEN c{k} <= "close" * (1 - 1.0 * vol) THEN {k}' for k in range(1, 6))} END AS dn
FROM (SELECT *, {', '.join(f'lead("close", {k}) OVER (PARTITION BY symbol ORDER BY ts) AS c{k}' for k in range(1, 6))},
        {gated('stddev_samp', 'ret_1d', 21)} AS vol FROM px_ret)"""


@query("lab_08_arm_labels", f"""
WITH a AS ({_ARM_SRC})
SELECT symbol, ts, 'signed_return' AS label_id, 5 AS horizon_bars, {r6('c5 / "close" - 1','y')} FROM a
UNION ALL SELECT symbol, ts, 'vol_scaled', 5, {r6('(c5 / "close" - 1) / nullif(vol, 0)')} FROM a
UNION ALL SELECT symbol, ts, 'triple_barrier', 5, {_TB} FROM a""")
def _(t):
    return lab.arm_labels(t.bars()).withColumn("y", F.round("y", 6))


@query("lab_03_triple_barrier", f"SELECT symbol, ts, {_TB} AS y FROM ({_ARM_SRC})")
def _(t):
    return lab.arm_labels(t.bars()).where("label_id = 'triple_barrier'").select("symbol", "ts", "y")


_DD = """
SELECT symbol, ts, CASE WHEN count(*) = 22 THEN CAST(min(p / peak - 1) <= -0.045 AS DOUBLE) END AS y FROM (
  SELECT symbol, ts, p, max(p) OVER (PARTITION BY symbol, ts ORDER BY j) AS peak FROM (
    SELECT a.symbol, a.ts, b.n - a.n AS j, b."close" AS p FROM
      (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars) a JOIN
      (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars) b
      ON a.symbol = b.symbol AND b.n BETWEEN a.n AND a.n + 21))
GROUP BY 1, 2"""


@query("lab_07_target_labels", f"""
SELECT symbol, ts, 'drawdown_21d' AS label_id, 21 AS horizon_bars, y FROM ({_DD})
UNION ALL SELECT symbol, ts, 'realized_vol_21d', 21, {r6('ln(nullif(' + gated('stddev_samp','ret_1d',21,'1 FOLLOWING','21 FOLLOWING') + ', 0))')} FROM px_ret
UNION ALL SELECT symbol, ts, 'directional_5d', 5, CAST(lead("close", 5) OVER (PARTITION BY symbol ORDER BY ts) / "close" - 1 > 0 AS DOUBLE) FROM bars
UNION ALL SELECT symbol, ts, 'directional_21d', 21, CAST(lead("close", 21) OVER (PARTITION BY symbol ORDER BY ts) / "close" - 1 > 0 AS DOUBLE) FROM bars""")
def _(t):
    return lab.target_labels(t.bars(), depth=0.045).withColumn("y", F.round("y", 6))


@query("lab_08_uniform_horizon", """
SELECT CAST(1 AS BIGINT) AS n_horizons, count(*) > 0 AS uniform FROM bars""")
def _(t):
    return lab.horizons_agree(lab.arm_labels(t.bars()))


@query("lab_09_next_open_sign", """
SELECT symbol, ts, sign(ln(lead("close", 2) OVER w / lead("close", 1) OVER w)) + 0.0 AS y FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(t):
    return t.bars().select("symbol", "ts", lab.next_open_sign().alias("y"))


@query("lab_10_sample_weights", f"""
SELECT symbol, ts, {r6('w / avg(w) OVER (PARTITION BY symbol)','weight')} FROM (
  SELECT symbol, ts, list_sum(list_transform(range(1, 6), lambda j: 1.0::DOUBLE / greatest(1, least(pos + j - 1, n - 1) - greatest(0, pos + j - 5) + 1))) / 5 AS w
  FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars))""")
def _(t):
    return lab.sample_weights(t.bars(), 5).select("symbol", "ts", r("weight", "weight"))


# --- folds ----------------------------------------------------------------------------------
_PANEL = "SELECT symbol, ts, mom_21d, lead(c) OVER (PARTITION BY symbol ORDER BY ts) / c - 1 AS y FROM (SELECT f.*, b.\"close\" AS c FROM px_feat f JOIN bars b USING (symbol, ts))"
_COMPLETE = f"SELECT * FROM ({_PANEL}) WHERE mom_21d IS NOT NULL AND y IS NOT NULL"


def complete_panel(t):
    f = feat.price_features(t.bars().withColumn("y", lab.forward_return(1)))
    return materialized(f.select("symbol", "ts", "open", "volume", "mom_21d", "y").dropna())


@query("spl_01_fold_table", f"""
WITH {fold_ctes('SELECT ts FROM bars', rows=False)}
SELECT fold, s - 504 AS train_lo, s - 1 - 4 AS train_hi, s AS test_lo, s + 62 AS test_hi FROM folds""")
def _(t):
    from tidemark.operators.timejoin import master_calendar

    return spl.fold_table(master_calendar(t.bars()), WF)


@query("spl_05_fold_rows", f"""
WITH {fold_ctes(_COMPLETE)}
SELECT fold, role, symbol, ts, pos FROM fr""")
def _(t):
    rows = spl.assign_folds(spl.with_positions(complete_panel(t)), WF)
    return rows.select("fold", "role", "symbol", "ts", "pos")


@query("spl_07_fold_accounting", f"""
WITH {fold_ctes(_COMPLETE)}
SELECT fold, count(DISTINCT CASE WHEN role = 'test' THEN symbol END) AS active_symbols,
  count(CASE WHEN role = 'train' THEN 1 END) AS train_rows, count(CASE WHEN role = 'test' THEN 1 END) AS test_rows
FROM fr GROUP BY fold""")
def _(t):
    return spl.fold_accounting(spl.assign_folds(spl.with_positions(complete_panel(t)), WF))


@query("spl_06_inner_time_split", f"""
WITH {fold_ctes(_COMPLETE)},
ip AS (SELECT *, pos - (63 * fold) AS ipos FROM fr WHERE role = 'train'),
f2 AS (SELECT k AS inner_fold FROM generate_series(0, 2) t(k))
SELECT fold, inner_fold, CASE WHEN ipos >= 125 * (inner_fold + 1) THEN 'test' ELSE 'train' END AS inner_role, count(*) AS n_rows
FROM ip JOIN f2 ON (ipos BETWEEN 125 * (inner_fold + 1) AND 125 * (inner_fold + 2) - 1) OR ipos < 125 * (inner_fold + 1)
GROUP BY 1, 2, 3""")
def _(t):
    from tidemark.operators.models import inner_time_split

    rows = spl.assign_folds(spl.with_positions(complete_panel(t)), WF, ("train",))
    out = inner_time_split(rows, WF, n_splits=3)
    return out.groupBy("fold", "inner_fold", "inner_role").agg(F.count(F.lit(1)).alias("n_rows"))


# --- regimes --------------------------------------------------------------------------------
@query("reg_02_era_tags", "SELECT run, ts, regime FROM rets_era")
def _(t):
    return reg.tag(t.returns(), reg.era_detector(ERAS)).select("run", "ts", "regime")


@query("reg_01_vol_regime", """
SELECT symbol, ts, CASE WHEN VIXCLS <= 15 THEN 'low_vol' WHEN VIXCLS >= 25 THEN 'high_vol' ELSE 'mid_vol' END AS regime
FROM bars b JOIN macro_wide m ON m.day = CAST(b.ts AS DATE) WHERE VIXCLS IS NOT NULL""")
def _(t):
    from tidemark.operators.timejoin import macro_calendar

    vix = macro_calendar(t.macro(), feat.MACRO_SERIES, START, END, feat.PUBLICATION_LAGS).select(
        "day", F.col("VIXCLS").alias("value")).where("value IS NOT NULL")
    bars = t.bars().join(F.broadcast(vix.select("day")), F.to_date("ts") == F.col("day"), "left_semi")
    return reg.tag(bars, reg.vol_detector(vix)).select("symbol", "ts", "regime")


_AXES = f"""
SELECT ts, 'volatility' AS axis, CASE WHEN v <= 15 THEN 'low_vol' WHEN v >= 25 THEN 'high_vol' WHEN v IS NOT NULL THEN 'mid_vol' END AS condition FROM ax
UNION ALL SELECT ts, 'rates', CASE WHEN ch > 0.25 THEN 'rising' WHEN ch < -0.25 THEN 'falling' WHEN ch IS NOT NULL THEN 'flat' END FROM ax
UNION ALL SELECT ts, 'trend', trend FROM tx"""
AXES_CTES = f"""
mu AS (SELECT day, last_value(g IGNORE NULLS) OVER (ORDER BY day) AS g, last_value(v IGNORE NULLS) OVER (ORDER BY day) AS v FROM calendar_days LEFT JOIN (
        SELECT CAST("timestamp" AS DATE) AS day, max(CASE WHEN series_id = 'DGS10' THEN value END) AS g, max(CASE WHEN series_id = 'VIXCLS' THEN value END) AS v FROM macro GROUP BY 1) USING (day)),
dd AS (SELECT DISTINCT ts FROM bars),
ax AS (SELECT ts, v, g - lag(g, 63) OVER (ORDER BY ts) AS ch FROM dd JOIN mu ON mu.day = CAST(dd.ts AS DATE)),
bt AS (SELECT ts, CASE WHEN "close" > m THEN 'uptrend' WHEN m IS NOT NULL THEN 'downtrend' END AS c FROM (
        SELECT ts, "close", {gated('avg','"close"',200)} AS m FROM bars WHERE symbol = 'S1')),
tx AS (SELECT ts, last_value(c IGNORE NULLS) OVER (ORDER BY ts) AS trend FROM dd LEFT JOIN bt USING (ts))"""


def axes(t):
    bars = t.bars()
    return reg.market_axes(bars, t.macro(), bars.where("symbol = 'S1'"), START, END)


@query("reg_07_market_axes", f"WITH {AXES_CTES} SELECT * FROM ({_AXES}) WHERE condition IS NOT NULL")
def _(t):
    return axes(t)


AXES_SQL = _AXES


@query("agg_27_era_by_vol_crosstab", f"""
WITH {AXES_CTES}, e AS (SELECT ts, coalesce(eras.name, 'pre_qe') AS era, v FROM ax LEFT JOIN eras ON CAST(ts AS DATE) BETWEEN lo AND hi WHERE v IS NOT NULL)
SELECT era, count(CASE WHEN v >= 25 THEN 1 END) AS high_vol, count(CASE WHEN v <= 15 THEN 1 END) AS low_vol,
  count(CASE WHEN v > 15 AND v < 25 THEN 1 END) AS mid_vol FROM e GROUP BY era""")
def _(t):
    a = axes(t).where("axis = 'volatility'").withColumn("era", reg.era("ts", ERAS))
    return a.groupBy("era").pivot("condition", ["high_vol", "low_vol", "mid_vol"]).agg(F.count(F.lit(1))).na.fill(0)


# --- metrics --------------------------------------------------------------------------------
def rounded(df, *keys):
    return df.select(*keys, "n_bars", *[r(m, m, DIGITS[m]) for m in METRIC_NAMES])


@query("met_07_metrics_by_run", metrics_sql("rets", "run"))
def _(t):
    return rounded(met.return_metrics(t.returns(), ["run"]), "run")


@query("met_08_metrics_by_regime", f"""
WITH both_r AS (SELECT run, ts, ret, regime FROM rets_era UNION ALL SELECT run, ts, ret, 'aggregate' FROM rets_era)
{metrics_sql('both_r', 'run, regime')}""")
def _(t):
    tagged = reg.tag(t.returns(), reg.era_detector(ERAS))
    return rounded(met.regime_metrics(tagged, ["run"]), "run", "regime")


@query("agg_22_run_span", """
SELECT left(run, 2) AS run, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts) AS n_dates, count(DISTINCT run) AS n_symbols,
       count(DISTINCT regime) AS n_regimes FROM rets_era GROUP BY 1""")
def _(t):
    tagged = reg.tag(t.returns(), reg.era_detector(ERAS))
    return rpt.run_span(tagged.withColumn("symbol", F.col("run")).withColumn("run", F.substring("run", 1, 2)))


@query("tab_01_regime_summary", f"""
WITH p AS (SELECT ts, regime, avg(ret) AS ret FROM rets_era GROUP BY 1, 2)
SELECT regime, sharpe, sortino, max_drawdown, n_bars FROM ({metrics_sql('p', 'regime')})""")
def _(t):
    port = rep.cross_section_mean(t.returns().withColumn("all", F.lit(1)), ["all"])
    tagged = reg.tag(port, reg.era_detector(ERAS))
    return rounded(met.return_metrics(tagged, ["regime"]), "regime").select("regime", "sharpe", "sortino", "max_drawdown", "n_bars")


# --- replay ---------------------------------------------------------------------------------
_COST = "0.005::DOUBLE AS fee, 5.0 / 10000 AS slip, 0.10::DOUBLE AS cap"
_SIG = f"SELECT symbol AS g, ts, open, volume, coalesce(sign(\"close\" / lag(\"close\", 5) OVER (PARTITION BY symbol ORDER BY ts) - 1), 0) AS signal, {_COST} FROM bars"


def signalled(t):
    return t.bars().withColumn("signal", rep.sign_signal(win.pct_change("close", 5)))


@query("rep_01_replay_equity", f"WITH RECURSIVE {replay_ctes(_SIG)} SELECT g AS symbol, ts, {r6('equity','equity',3)} FROM eq")
def _(t):
    eq = rep.equity(rep.replay(signalled(t), ["symbol"], rep.BACKTEST_COSTS), ["symbol"])
    return eq.select("symbol", "ts", r("equity", "equity", 3))


@query("rep_02_trade_log", f"""WITH RECURSIVE {replay_ctes(_SIG)}
SELECT g AS symbol, ts, {r6('entry_price','entry_price')}, {r6('exit_price','exit_price')}, CAST(shares AS BIGINT) AS shares,
  {r6('gross_pnl','gross_pnl',3)}, {r6('commission','commission',3)}, {r6('gross_pnl - commission','net_pnl',3)} FROM pnl""")
def _(t):
    tr = rep.trades(rep.replay(signalled(t), ["symbol"], rep.BACKTEST_COSTS), ["symbol"])
    return tr.select("symbol", "ts", r("entry_price", "entry_price"), r("exit_price", "exit_price"), "shares",
                     r("gross_pnl", "gross_pnl", 3), r("commission", "commission", 3), r("net_pnl", "net_pnl", 3))


@query("met_06_trade_metrics", f"""WITH RECURSIVE {replay_ctes(_SIG)}
SELECT g AS symbol, count(*) AS n_trades, {r6('avg(CAST(gross_pnl - commission > 0 AS DOUBLE))','hit_rate')},
  CASE WHEN count(CASE WHEN gross_pnl < commission THEN 1 END) = 0 THEN CAST('inf' AS DOUBLE) ELSE
  {r6('coalesce(sum(CASE WHEN gross_pnl > commission THEN gross_pnl - commission END), 0) / abs(sum(CASE WHEN gross_pnl < commission THEN gross_pnl - commission END))')} END AS profit_factor
FROM pnl GROUP BY g""")
def _(t):
    tr = rep.trades(rep.replay(signalled(t), ["symbol"], rep.BACKTEST_COSTS), ["symbol"])
    return met.trade_metrics(tr, ["symbol"]).select("symbol", "n_trades", r("hit_rate", "hit_rate"), r("profit_factor", "profit_factor"))


@query("rep_08_signal_returns_by_date", f"""WITH RECURSIVE {replay_ctes(_SIG)}
SELECT ts, {r6('avg(ret)','ret')}, count(*) AS n_symbols FROM eq_ret GROUP BY ts""")
def _(t):
    ret = rep.replay_returns(signalled(t), ["symbol"], rep.BACKTEST_COSTS)
    return rep.cross_section_mean(ret, []).select("ts", r("ret", "ret"), "n_symbols")


@query("rep_15_vector_replay", f"""
SELECT symbol, ts, {r6('pos * mv - abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0)) * 5.0 / 10000','ret')} FROM (
  SELECT symbol, ts, coalesce(lag(s) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pos, lead(open) OVER (PARTITION BY symbol ORDER BY ts) / open - 1 AS mv
  FROM (SELECT *, CAST(coalesce(sign("close" / lag("close", 5) OVER (PARTITION BY symbol ORDER BY ts) - 1), 0) AS INTEGER) AS s FROM bars))
QUALIFY mv IS NOT NULL""")
def _(t):
    return rep.vector_replay(signalled(t), ["symbol"]).select("symbol", "ts", r("ret", "ret"))


# --- the whole chain ------------------------------------------------------------------------
def fold_replay(t, wf=WF):
    rows = spl.assign_folds(spl.with_positions(complete_panel(t)), wf, ("test",))
    rows = rows.withColumn("signal", rep.sign_signal("mom_21d"))
    return rep.replay(rows, ["fold", "symbol"], rep.BACKTEST_COSTS)


_CHAIN = f"""{fold_ctes("SELECT c.*, b.open, b.volume FROM (" + _COMPLETE + ") c JOIN bars b USING (symbol, ts)")},
{replay_ctes("SELECT fold || '|' || symbol AS g, ts, open, volume, CAST(sign(mom_21d) AS INTEGER) AS signal, " + _COST + " FROM fr WHERE role = 'test'")},
port AS (SELECT CAST(split_part(g, '|', 1) AS BIGINT) AS fold, ts, avg(ret) AS ret, count(*) AS n_symbols FROM eq_ret GROUP BY 1, 2),
port_era AS (SELECT port.*, coalesce(eras.name, 'pre_qe') AS regime FROM port LEFT JOIN eras ON CAST(ts AS DATE) BETWEEN lo AND hi)"""


def portfolio(t):
    ret = rep.bar_returns(rep.equity(fold_replay(t), ["fold", "symbol"]), ["fold", "symbol"])
    return rep.cross_section_mean(ret, ["fold"])


@query("rep_04_portfolio_returns", f"WITH RECURSIVE {_CHAIN} SELECT fold, ts, {r6('ret','ret')}, n_symbols FROM port")
def _(t):
    return portfolio(t).select("fold", "ts", r("ret", "ret"), "n_symbols")


@query("rep_06_portfolio_equity", f"""WITH RECURSIVE {_CHAIN}
SELECT ts, {r6('100000 * product(1 + ret) OVER (ORDER BY ts)','equity',3)} FROM port""")
def _(t):
    p = portfolio(t).withColumn("run", F.lit("momentum"))
    return rep.portfolio_equity(p, ["run"]).select("ts", r("equity", "equity", 3))


@query("walkforward_momentum_metrics", f"""WITH RECURSIVE {_CHAIN},
both_r AS (SELECT ts, ret, regime FROM port_era UNION ALL SELECT ts, ret, 'aggregate' FROM port_era)
{metrics_sql('both_r', 'regime')}""")
def _(t):
    tagged = reg.tag(portfolio(t).withColumn("run", F.lit("momentum")), reg.era_detector(ERAS))
    return rounded(met.regime_metrics(tagged, ["run"]), "regime")


@query("met_19_metrics_by_fold", f"WITH RECURSIVE {_CHAIN} {metrics_sql('port', 'fold')}")
def _(t):
    return rounded(met.return_metrics(portfolio(t), ["fold"]), "fold")
