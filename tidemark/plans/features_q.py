"""Feature, window and cross-section queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.operators import windows as win
from tidemark.operators.ranks import percent_rank_columns
from tidemark.operators.timejoin import document_windows, macro_calendar
from tidemark.plans.oracle_ctes import gated
from tidemark.plans.registry import query, r6
from tidemark.sources.lake import materialized

START, END = "1995-01-01", "2001-12-31"


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


PX = feat.PRICE_COLUMNS


@query("bars_daily_ohlcv", f"""SELECT symbol, ts, {r6('open','open')}, {r6('high','high')}, {r6('low','low')},
  {r6('"close"','"close"')}, {r6('volume','volume',3)} FROM bars""")
def _(t):
    return t.bars().select("symbol", "ts", *[r(c, c) for c in ("open", "high", "low", "close")], r("volume", "volume", 3))


@query("fea_30_price_features", "SELECT symbol, ts, " + ", ".join(r6(c, c) for c in PX) + " FROM px_feat")
def _(t):
    return feat.price_features(t.bars()).select("symbol", "ts", *[r(c, c) for c in PX])


@query("fea_32_macro_calendar", f"""SELECT CAST(day AS VARCHAR) AS day, {r6('DGS10','DGS10')}, {r6('DFF','DFF')}, {r6('VIXCLS','VIXCLS')} FROM macro_wide""")
def _(t):
    return macro_calendar(t.macro(), feat.MACRO_SERIES, START, END, feat.PUBLICATION_LAGS).select(
        F.col("day").cast("string").alias("day"), *[r(c, c) for c in feat.MACRO_SERIES])


@query("fea_31_regime_flags", f"""
SELECT f.symbol, f.ts, {r6('DGS10','DGS10')}, {r6('DFF','DFF')}, {r6('VIXCLS','VIXCLS')}, {r6('DGS10 - DFF','yield_curve')},
  CASE WHEN VIXCLS <= 15 THEN 0.0 WHEN VIXCLS >= 25 THEN 2.0 WHEN VIXCLS IS NOT NULL THEN 1.0 END::DOUBLE AS vix_regime,
  CAST(DGS10 - DFF < 0 AS DOUBLE) AS curve_inverted, {r6('vol_21d / nullif(vol_63d, 0)','vol_regime_ratio')},
  CAST(ma200_ratio > 1 AS DOUBLE) AS trend_regime
FROM px_feat f LEFT JOIN macro_wide m ON m.day = CAST(f.ts AS DATE)""")
def _(t):
    f = feat.regime_flags(feat.with_macro(feat.price_features(t.bars()), t.macro(), START, END))
    return f.select("symbol", "ts", *[r(c, c) for c in ("DGS10", "DFF", "VIXCLS", "yield_curve")],
                    "vix_regime", "curve_inverted", r("vol_regime_ratio", "vol_regime_ratio"), "trend_regime")


_XS = ", ".join(
    r6(f"""CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY ts) >= 5 THEN
      (rank() OVER (PARTITION BY ts, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0)
      / count({c}) OVER (PARTITION BY ts) END""", f"xs_rank_{c}") for c in feat.RANKED)


@query("win_11_cross_section_rank", f"SELECT symbol, ts, {_XS} FROM px_feat")
def _(t):
    f = materialized(feat.price_features(t.bars()).select("symbol", "ts", *feat.RANKED))
    return percent_rank_columns(f, feat.RANKED).select("symbol", "ts", *[r(f"xs_rank_{c}", f"xs_rank_{c}") for c in feat.RANKED])


@query("jon_07_document_window", f"SELECT symbol, ts, {r6('sentiment_score','sentiment_score')}, doc_count, has_coverage FROM doc_feat")
def _(t):
    days = document_windows(t.docs(), t.bars().withColumn("ts", F.to_date("ts")))
    return days.withColumns({"ts": F.col("ts").cast("timestamp"), "sentiment_score": F.round("sentiment_score", 6)})


@query("jon_07_document_window_instant", f"""
WITH b AS (SELECT symbol, ts + INTERVAL 870 MINUTES AS ts FROM bars)
SELECT b.symbol, b.ts, {r6('coalesce(avg(d.sentiment_score), 0.0)','sentiment_score')}, count(d.document_id) AS doc_count,
  count(d.document_id) > 0 AS has_coverage
FROM b LEFT JOIN docs d ON d.symbol = b.symbol AND d.published_at < b.ts AND d.published_at >= b.ts - INTERVAL 30 DAYS GROUP BY 1, 2""")
def _(t):
    bars = t.bars().withColumn("ts", F.expr("ts + INTERVAL 870 MINUTES"))
    return document_windows(t.docs(), bars).withColumn("sentiment_score", F.round("sentiment_score", 6))


_WHOLE = ("doc_count", "has_coverage")


def full_features(t):
    """All 27 columns; what they need of the bars is written once."""
    bars = materialized(t.bars().select("symbol", "ts", "close", "volume"))
    return feat.build_features(bars, t.macro(), t.docs(), start=START, end=END, ranks=True, daily=True)


@query("fea_33_build_features", "SELECT symbol, ts, doc_count, has_coverage, " + ", ".join(
    r6(c, c) for c in feat.ALL_COLUMNS if c not in _WHOLE) + " FROM full_feat")
def _(t):
    f = full_features(t)
    return f.select("symbol", "ts", *_WHOLE, *[r(c, c) for c in feat.ALL_COLUMNS if c not in _WHOLE])


@query("fea_34_asof_feature_row", f"""
SELECT symbol, ts, {", ".join(r6(c, c) for c in PX)} FROM px_feat
WHERE ts <= TIMESTAMP '2000-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def _(t):
    f = feat.build_features(t.bars(), start=START, end=END, asof="2000-06-30")
    return win.latest_rows(f, "symbol").select("symbol", "ts", *[r(c, c) for c in PX])


@query("fea_35_crossover_signal", f"""
SELECT symbol, ts, CASE WHEN f > s THEN 1 WHEN f < s THEN -1 ELSE 0 END AS signal FROM (
  SELECT symbol, ts, {gated('avg','"close"',50)} AS f, {gated('avg','"close"',200)} AS s FROM bars)""")
def _(t):
    return feat.crossover_signal(t.bars()).select("symbol", "ts", "signal")


@query("fea_36_ewma_log_vol", f"""
WITH RECURSIVE r AS (SELECT symbol, ts, ret_1d * ret_1d AS r2, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n
                     FROM px_ret WHERE ret_1d IS NOT NULL),
v AS (SELECT symbol, ts, n, r2 AS v FROM r WHERE n = 1
      UNION ALL SELECT r.symbol, r.ts, r.n, 0.94 * v.v + (1 - 0.94) * r.r2 FROM v JOIN r ON r.symbol = v.symbol AND r.n = v.n + 1)
SELECT symbol, ts, {r6('ln(sqrt(v))','ewma_log_vol')} FROM v""")
def _(t):
    out = win.ewma_log_vol(t.bars()).where("ewma_log_vol IS NOT NULL")
    return out.select("symbol", "ts", r("ewma_log_vol", "ewma_log_vol"))


@query("win_15_rolling_sharpe", f"""
SELECT run, ts, {r6(gated('avg','ret',63,part='run') + ' / nullif(' + gated('stddev_samp','ret',63,part='run') + ', 0) * sqrt(252)', 'rolling_sharpe')} FROM rets""")
def _(t):
    return t.returns().select("run", "ts", r(win.rolling_sharpe("ret", 63, "run"), "rolling_sharpe"))


@query("win_16_rolling_hit_rate", f"""
SELECT symbol, ts, {r6(gated('avg','hit',63),'hit_rate')} FROM (
  SELECT symbol, ts, CASE WHEN p IS NOT NULL AND ret_1d IS NOT NULL THEN CAST(sign(p) = sign(ret_1d) AS DOUBLE) END AS hit
  FROM (SELECT *, lag(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM px_ret))""")
def _(t):
    b = t.bars().withColumn("ret", win.pct_change("close", 1))
    b = b.withColumn("hit", (F.signum(F.lag("ret", 1).over(win.per("symbol"))) == F.signum("ret")).cast("double"))
    return b.select("symbol", "ts", r(win.rolling_mean("hit", 63), "hit_rate"))


@query("win_18_trailing_change", f"""
SELECT series_id, "timestamp", {r6('value - lag(value, 63) OVER (PARTITION BY series_id ORDER BY "timestamp")','change_63')} FROM macro""")
def _(t):
    return t.macro().select("series_id", "timestamp", r(
        F.col("value") - F.lag("value", 63).over(win.per("series_id", order="timestamp")), "change_63"))


@query("win_19_lagged_log_returns", "SELECT symbol, ts, " + ", ".join(
    r6(f"lag(lr, {k}) OVER (PARTITION BY symbol ORDER BY ts)", f"lag_{k}") for k in (1, 2, 3, 5, 10)) +
    ' FROM (SELECT symbol, ts, ln("close" / lag("close") OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM bars)')
def _(t):
    w = win.per("symbol")
    b = t.bars().withColumn("lr", F.ln(F.try_divide("close", F.lag("close", 1).over(w))))
    return b.select("symbol", "ts", *[r(F.lag("lr", k).over(w), f"lag_{k}") for k in (1, 2, 3, 5, 10)])


@query("win_09_growth_and_drawdown", f"""
SELECT run, ts, {r6('g','growth')}, {r6('g / max(g) OVER (PARTITION BY run ORDER BY ts) - 1','drawdown')} FROM (
  SELECT run, ts, exp(sum(ln(1 + ret)) OVER (PARTITION BY run ORDER BY ts)) AS g FROM rets)""")
def _(t):
    g = t.returns().withColumn("g", win.compounded("ret", "run"))
    return g.select("run", "ts", r("g", "growth"), r(F.col("g") / win.running_max("g", "run") - 1, "drawdown"))


@query("win_22_signal_islands", """
SELECT symbol, ts, signal, CAST(coalesce(sum(CASE WHEN p IS NOT NULL AND p <> signal THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts), 0) AS BIGINT) AS island FROM (
  SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM (
    SELECT symbol, ts, CAST(coalesce(sign(ret_1d), 0) AS INTEGER) AS signal FROM px_ret))""")
def _(t):
    s = t.bars().select("symbol", "ts", F.coalesce(F.signum(win.pct_change("close", 1)), F.lit(0.0)).cast("int").alias("signal"))
    return win.with_islands(s, "signal").withColumn("island", F.col("island").cast("bigint"))


@query("win_20_cumulative_loss_differential", f"""
SELECT symbol, ts, {r6('sum(e1 * e1 - e2 * e2) OVER (PARTITION BY symbol ORDER BY ts)','cum_loss_diff')} FROM (
  SELECT symbol, ts, y - ret_1d AS e1, y AS e2 FROM (
    SELECT symbol, ts, ret_1d, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_ret)
  WHERE ret_1d IS NOT NULL AND y IS NOT NULL)""")
def _(t):
    b = t.bars().withColumn("ret", win.pct_change("close", 1))
    b = b.withColumn("y", win.forward("ret", 1)).where("ret IS NOT NULL AND y IS NOT NULL")
    diff = F.pow(F.col("y") - F.col("ret"), 2) - F.pow("y", 2)
    return b.select("symbol", "ts", r(F.sum(diff).over(win.per("symbol").rowsBetween(Window.unboundedPreceding, 0)), "cum_loss_diff"))


@query("win_21_document_count_mean", f"""
SELECT symbol, ts, {r6(gated('avg','doc_count',63),'mean_doc_count')} FROM doc_feat""")
def _(t):
    d = document_windows(t.docs(), t.bars())
    return d.select("symbol", "ts", r(win.rolling_mean("doc_count", 63), "mean_doc_count"))


@query("srt_03_last_rows_per_symbol", f"""
SELECT symbol, ts, {r6('"close"','"close"')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3""")
def _(t):
    return win.latest_rows(t.bars(), "symbol", 3).select("symbol", "ts", r("close", "close"))


@query("srt_04_downsample", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY run) AS c FROM rets)
SELECT run, ts, {r6('ret','ret')} FROM n WHERE c <= 60 OR i IN (SELECT CAST(round_even(k * ((m.c - 1) / 59.0::DOUBLE), 0) AS BIGINT) FROM range(60) t(k), (SELECT n.c AS c) m)""")
def _(t):
    return win.downsample(t.returns(), 60).select("run", "ts", r("ret", "ret"))


@query("srt_06_systematic_sample", """
SELECT symbol, ts FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
  greatest(count(*) OVER (PARTITION BY symbol) // 40, 1) AS step FROM bars) WHERE i % step = 0 AND i // step < 40""")
def _(t):
    return win.systematic_sample(t.bars(), 40, "symbol").select("symbol", "ts")
