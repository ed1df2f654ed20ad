"""Strategy detail, heat map and single-symbol evaluation queries."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.operators import labels as lab
from tidemark.operators import metrics as met
from tidemark.operators import monitor as mon
from tidemark.operators import replay as rep
from tidemark.operators import reports as rpt
from tidemark.operators import splits as spl
from tidemark.operators import windows as win
from tidemark.plans.desk_q import _PSI, CATALOG_SQL, DRIFT, catalog, monitored
from tidemark.plans.evaluation_q import _COST, AXES_CTES, AXES_SQL, axes
from tidemark.plans.oracle_ctes import gated
from tidemark.plans.registry import query, r6
from tidemark.plans.sql_parts import metrics_sql, replay_ctes
from tidemark.sources.derive import daily_bars
from tidemark.sources.lake import materialized


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


@query("tab_06_strategy_detail", f"""
WITH g AS (SELECT run, ts, product(1 + ret) OVER (PARTITION BY run ORDER BY ts) AS g, {gated('avg', 'ret', 63, part='run')} / nullif({gated('stddev_samp', 'ret', 63, part='run')}, 0) * sqrt(252) AS rs,
  row_number() OVER (PARTITION BY run ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY run) AS c FROM rets),
d AS (SELECT *, g / max(g) OVER (PARTITION BY run ORDER BY ts) - 1 AS dd FROM g)
SELECT run, ts, {r6('g','growth')}, {r6('dd','drawdown')}, {r6('rs','rolling_sharpe')} FROM d WHERE c <= 100 OR i IN (SELECT CAST(round_even(k * ((m.c - 1) / 99.0::DOUBLE), 0) AS BIGINT) FROM range(100) t(k), (SELECT d.c AS c) m)""")
def _(t):
    g = t.returns().withColumns({"growth": win.compounded("ret", "run"), "rs": win.rolling_sharpe("ret", 63, "run")})
    d = g.withColumn("drawdown", F.col("growth") / win.running_max("growth", "run") - 1)
    return win.downsample(d, 100).select("run", "ts", r("growth", "growth"), r("drawdown", "drawdown"), r("rs", "rolling_sharpe"))


@query("tab_06_return_histogram", """
WITH e AS (SELECT run, min(ret) AS lo, max(ret) AS hi FROM rets GROUP BY 1)
SELECT run, CAST(least(floor((ret - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM rets JOIN e USING (run) GROUP BY 1, 2""")
def _(t):
    return rpt.histogram(t.returns(), ["run"], "ret", 20).select("run", "bin", "n")


@query("tab_09_catalog_summary", f"""WITH {_PSI}, v AS (SELECT coalesce(verdict, 'unmeasured') AS verdict, coverage FROM (SELECT {CATALOG_SQL} AS name FROM part) f LEFT JOIN fs ON fs.feature = f.name)
SELECT count(*) AS n_features, {', '.join(f"count(CASE WHEN verdict = '{v}' THEN 1 END) AS n_{v}" for v in ('stable', 'drifting', 'stale', 'unmeasured'))}, {r6('avg(coverage)','mean_coverage')} FROM v""")
def _(t):
    stats = mon.feature_stats(monitored(t), DRIFT).select("feature", "coverage", "verdict")
    return rpt.catalog_summary(rpt.catalog_view(catalog(t), stats)).withColumn("mean_coverage", F.round("mean_coverage", 6))


@query("met_16_condition_heat_map", f"""WITH {AXES_CTES}, la AS (SELECT * FROM ({AXES_SQL}) WHERE condition IS NOT NULL),
s AS (SELECT run, condition, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS s FROM rets JOIN la USING (ts) GROUP BY 1, 2)
SELECT run, {', '.join(r6(f"max(CASE WHEN condition = '{c}' THEN s END)", c) for c in ('low_vol', 'mid_vol', 'high_vol', 'uptrend', 'downtrend'))} FROM s GROUP BY 1""")
def _(t):
    wanted = ["low_vol", "mid_vol", "high_vol", "uptrend", "downtrend"]
    s = rpt.sharpe_by_condition(t.returns(), axes(t))
    return s.groupBy("run").pivot("condition", wanted).agg(F.first("sharpe")).select("run", *[r(c, c) for c in wanted])


_OWN = f"""
p AS (SELECT * FROM (SELECT f.symbol, f.ts, b.open, b.volume, mom_21d, lead(b."close") OVER (PARTITION BY f.symbol ORDER BY f.ts) AS nx FROM px_feat f JOIN bars b USING (symbol, ts)) WHERE mom_21d IS NOT NULL AND nx IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM p),
w AS (SELECT q.*, k AS fold FROM q, generate_series(0, 40) t(k) WHERE pos BETWEEN 252 + k * 63 AND 252 + k * 63 + 62 AND 252 + k * 63 + 63 <= n),
{replay_ctes("SELECT symbol || '|' || fold AS g, ts, open, volume, CAST(mom_21d AS INTEGER) AS signal, " + _COST + " FROM w")},
o AS (SELECT split_part(g, '|', 1) AS symbol, ts, ret FROM eq_ret)"""


@query("abl_01_single_symbol_walkforward", f"WITH RECURSIVE {_OWN} {metrics_sql('o', 'symbol')}")
def _(t):
    f = feat.price_features(t.bars().withColumn("y", lab.forward_return(1)))
    rows = materialized(f.select("symbol", "ts", "open", "volume", "mom_21d", "y").dropna())
    own = Window.partitionBy("symbol")  # each symbol has its own calendar here
    placed = rows.withColumns({"pos": (F.row_number().over(own.orderBy("ts")) - 1).cast("bigint"), "n_days": F.count(F.lit(1)).over(own)})
    test = spl.assign_folds(placed, spl.WalkForward(252, 63, 63, 3, 1), ("test",)).withColumn("signal", rep.sign_signal("mom_21d"))
    ret = rep.replay_returns(test, ["symbol", "fold"], rep.BACKTEST_COSTS)
    m = met.return_metrics(ret, ["symbol"])
    from tidemark.plans.sql_parts import DIGITS, METRIC_NAMES

    return m.select("symbol", "n_bars", *[r(c, c, DIGITS[c]) for c in METRIC_NAMES])


_IS = f"""
p AS (SELECT * FROM (SELECT f.symbol, f.ts, b.open, b.volume, mom_21d FROM px_feat f JOIN bars b USING (symbol, ts)) WHERE mom_21d IS NOT NULL),
{replay_ctes("SELECT symbol || '|' || CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'is' ELSE 'oos' END AS g, ts, open, volume, CAST(mom_21d AS INTEGER) AS signal, " + _COST + " FROM p")},
s AS (SELECT split_part(g, '|', 1) AS symbol, avg(CASE WHEN g LIKE '%|is' THEN ret END) / stddev_samp(CASE WHEN g LIKE '%|is' THEN ret END) * sqrt(252) AS i,
 avg(CASE WHEN g LIKE '%|oos' THEN ret END) / stddev_samp(CASE WHEN g LIKE '%|oos' THEN ret END) * sqrt(252) AS o FROM eq_ret GROUP BY 1)"""


@query("met_13_in_and_out_of_sample", f"WITH RECURSIVE {_IS} SELECT symbol, {r6('i','in_sample')}, {r6('o','out_of_sample')}, abs(i / o) < 2 AS ratio_ok FROM s")
def _(t):
    f = feat.price_features(t.bars()).where("mom_21d IS NOT NULL").withColumn("sample", F.when(F.col("ts") < "1999-01-01", "is").otherwise("oos"))
    ret = rep.replay_returns(f.withColumn("signal", rep.sign_signal("mom_21d")), ["symbol", "sample"], rep.BACKTEST_COSTS)
    w = ret.groupBy("symbol").pivot("sample", ["is", "oos"]).agg(met.sharpe("ret"))
    return w.select("symbol", r("is", "in_sample"), r("oos", "out_of_sample"), (F.abs(F.try_divide("is", "oos")) < 2).alias("ratio_ok"))


# --- injected sources -----------------------------------------------------------------------
def brand_bars(t):
    """Daily bars by brand of the part instead of by supplier."""
    brand = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    ticks = t.raw("lineitem").join(brand, "l_partkey").withColumn("l_suppkey", F.concat(F.lit("_"), "p_brand"))
    return daily_bars(ticks)


def desk_plan(t):
    """One plan: momentum sign of the last bar, its close, and Sharpe of following it."""
    b = t.bars().withColumns({"ret": win.pct_change("close", 1), "mom": win.pct_change("close", 5)})
    b = b.withColumn("earned", F.signum(F.lag("mom", 1).over(win.per("symbol"))) * F.col("ret"))
    return b.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.signum(F.max_by("mom", "ts")).alias("signal"),
                                   met.sharpe("earned").alias("sharpe"), F.count("earned").alias("n_bars"))


_DESK = """SELECT symbol, arg_max("close", ts) AS "close", sign(arg_max(coalesce(mom, 1e9), ts)) AS signal, CASE WHEN stddev_samp(e) > 0 THEN avg(e) / stddev_samp(e) * sqrt(252) ELSE 0 END AS sharpe, count(e) AS n_bars FROM (
  SELECT *, sign(lag(mom) OVER (PARTITION BY symbol ORDER BY ts)) * ret AS e FROM (SELECT *, "close" / lag("close") OVER w - 1 AS ret, "close" / lag("close", 5) OVER w - 1 AS mom FROM {} WINDOW w AS (PARTITION BY symbol ORDER BY ts))) GROUP BY 1"""


@query("udf_06_injected_sources", f"""
WITH bb AS (SELECT 'S_' || p_brand AS symbol, l_shipdate AS ts, arg_max(px, k) AS "close" FROM (SELECT *, 100 + l_extendedprice / 20011.7 AS px, (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS k
  FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2)
SELECT source, symbol, {r6('"close"','"close"')}, signal, {r6('sharpe','sharpe')}, n_bars FROM (
  SELECT 'suppliers' AS source, * FROM ({_DESK.format('bars')}) UNION ALL SELECT 'brands', * FROM ({_DESK.format('bb')}))""")
def _(t):
    """The same plan on the tables' own bars and on injected ones."""
    out = [desk_plan(x).withColumn("source", F.lit(n)) for n, x in (("suppliers", t), ("brands", t.with_sources(bars=brand_bars)))]
    return out[0].unionByName(out[1]).select("source", "symbol", r("close", "close"), "signal", r("sharpe", "sharpe"), "n_bars")
