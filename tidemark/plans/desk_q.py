"""Sizing, order, monitoring and report-view queries."""
from pyspark.sql import functions as F

from tidemark.functions import dates as dt
from tidemark.functions import text
from tidemark.operators import features as feat
from tidemark.operators import gates as gat
from tidemark.operators import metrics as met
from tidemark.operators import models as mod
from tidemark.operators import monitor as mon
from tidemark.operators import orders as od
from tidemark.operators import replay as rep
from tidemark.operators import reports as rpt
from tidemark.operators import timejoin as tj
from tidemark.operators import windows as win
from tidemark.operators.ranks import percent_rank_columns
from tidemark.plans.evaluation_q import AXES_CTES, AXES_SQL, axes
from tidemark.plans.features_q import END, START
from tidemark.plans.oracle_ctes import _RANK
from tidemark.plans.registry import query, r6
from tidemark.plans.sql_parts import metrics_sql, replay_ctes
from tidemark.plans.stats_q import MAX_SHARPE
from tidemark.sources.lake import materialized

ASOF = "1999-06-30"


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


# --- signals, sizes, orders -----------------------------------------------------------------
def daily_signals(t):
    """AR(1) forecast of each symbol from its history up to the as-of instant."""
    h = tj.pit_panel(t.bars(), ASOF).withColumn("y", win.pct_change("close", 1))
    f = mod.one_step_forecast(h)
    return f.select("symbol", "forecast", od.target_position("forecast").alias("target"))


def last_prices(t):
    return tj.pit_latest(t.bars().select("symbol", "ts", "close"), ASOF).select("symbol", F.col("close").alias("price"))


_SIGS = f"""
h AS (SELECT symbol, ts, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY ts) - 1 AS y FROM bars WHERE ts <= TIMESTAMP '{ASOF}'),
h2 AS (SELECT *, lag(y) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM h WHERE y IS NOT NULL),
fc AS (SELECT symbol, regr_slope(y, p) AS phi, regr_intercept(y, p) AS c, arg_max(y, ts) AS l, count(y) AS n FROM h2 GROUP BY 1),
sg AS (SELECT symbol, c / (1 - phi) + phi * (l - c / (1 - phi)) AS forecast, CAST(sign(c / (1 - phi) + phi * (l - c / (1 - phi))) AS INTEGER) AS target FROM fc WHERE n >= 30),
pr AS (SELECT symbol, arg_max("close", ts) AS price FROM bars WHERE ts <= TIMESTAMP '{ASOF}' GROUP BY 1)"""


@query("exe_01_daily_signals", f"WITH {_SIGS} SELECT symbol, {r6('forecast','forecast',8)}, target FROM sg")
def _(t):
    return daily_signals(t).select("symbol", r("forecast", "forecast", 8), "target")


@query("exe_07_latest_prices", f"WITH {_SIGS} SELECT symbol, {r6('price','price')} FROM pr")
def _(t):
    return last_prices(t).select("symbol", r("price", "price"))


# Strategies are suppliers; each trades its own symbol and the symbols of the two next keys.
_UNI = """un AS (SELECT 'st' || s_suppkey AS strategy, 'S' || (s_suppkey + j) AS symbol, 100000.0 * (1 + s_suppkey % 3) AS budget, 3 AS n_symbols, 1.0 / (1 + s_suppkey % 4) AS weight,
  CASE WHEN s_suppkey % 11 = 0 THEN 0.5 ELSE 1.0 END AS max_position FROM supplier, range(3) t(j))"""
_SIZED = f"""{_SIGS}, {_UNI},
sz AS (SELECT un.*, sg.target, CASE WHEN sg.target <> 0 THEN sg.target * trunc(budget / n_symbols / (price * (1 + sg.target * 5.0 / 10000))) ELSE 0 END AS shares,
  price * (1 + sg.target * 5.0 / 10000) AS fill FROM un JOIN sg USING (symbol) JOIN pr USING (symbol)),
nt AS (SELECT symbol, sign(sum(weight * target)) AS d, sum(shares) AS s, sum(shares * fill) AS n, min(max_position) AS cap FROM sz GROUP BY 1),
nx AS (SELECT symbol, CAST(CASE WHEN abs(d) <= cap THEN d ELSE 0 END AS INTEGER) AS target, CASE WHEN abs(d) <= cap AND d <> 0 THEN abs(s) ELSE 0 END::DOUBLE AS shares,
  CASE WHEN abs(d) <= cap AND d <> 0 THEN n ELSE 0 END AS notional FROM nt)"""


def universe(t):
    k = F.col("s_suppkey")
    return t.raw("supplier").select(
        F.concat(F.lit("st"), k.cast("string")).alias("strategy"), F.explode(F.array(*[F.concat(F.lit("S"), (k + j).cast("string")) for j in range(3)])).alias("symbol"),
        (100000.0 * (1 + k % 3)).alias("budget"), F.lit(3).alias("n_symbols"), (1.0 / (1 + k % 4)).alias("weight"),
        F.when(k % 11 == 0, 0.5).otherwise(1.0).alias("max_position"))


def sized(t):
    return od.size_equal_weight(universe(t), daily_signals(t), last_prices(t))


@query("exe_03_equal_weight_sizes", f"WITH {_SIZED} SELECT strategy, symbol, target, shares::DOUBLE AS shares, {r6('shares * fill','notional',2)} FROM sz")
def _(t):
    return sized(t).select("strategy", "symbol", "target", "shares", r("notional", "notional", 2))


@query("exe_05_net_targets", f"WITH {_SIZED} SELECT symbol, target, shares, {r6('notional','notional',2)} FROM nx")
def _(t):
    return od.net_targets(sized(t)).select("symbol", "target", "shares", r("notional", "notional", 2))


@query("exe_06_order_deltas", f"""WITH {_SIZED}, ho AS (SELECT 'S' || (s_suppkey * 2) AS symbol, CAST(s_suppkey % 7 * 100 AS DOUBLE) AS qty FROM supplier),
j AS (SELECT coalesce(nx.symbol, ho.symbol) AS symbol, coalesce(target * shares, 0) - coalesce(qty, 0) AS delta FROM nx FULL JOIN ho ON nx.symbol = ho.symbol)
SELECT symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS qty FROM j WHERE abs(delta) >= 1e-9""")
def _(t):
    k = F.col("s_suppkey")
    held = t.raw("supplier").select(F.concat(F.lit("S"), (k * 2).cast("string")).alias("symbol"), (k % 7 * 100).cast("double").alias("qty"))
    return od.order_deltas(od.net_targets(sized(t)), held)


@query("exe_04_cash_fraction_sizes", """
SELECT symbol, ts, CASE WHEN sg = 0 THEN 0 ELSE greatest(0, least(CAST(trunc(50000 / ("close" * (1 + sg * 5.0 / 10000))) AS BIGINT), CAST(trunc(volume * 0.1) AS BIGINT))) END AS shares FROM (
 SELECT *, CAST(coalesce(sign("close" - lag("close") OVER (PARTITION BY symbol ORDER BY ts)), 0) AS INTEGER) AS sg FROM bars)""")
def _(t):
    b = t.bars().withColumn("sg", rep.sign_signal(win.pct_change("close", 1)))
    return b.select("symbol", "ts", od.cash_fraction_shares(F.lit(50000.0), F.col("close"), F.col("sg"), F.col("volume")).alias("shares"))


@query("exe_02_target_positions", """
SELECT symbol, ts, CAST(coalesce(sign(x), 0) AS INTEGER) AS target FROM (SELECT symbol, ts, CASE WHEN volume > 50000 THEN NULL ELSE ret_1d END AS x FROM px_ret)""")
def _(t):
    b = t.bars().withColumn("x", F.when(F.col("volume") > 60000, F.lit(float("nan"))).when(F.col("volume") > 50000, F.lit(float("inf"))).otherwise(win.pct_change("close", 1)))
    return b.select("symbol", "ts", od.target_position("x").alias("target"))


@query("gat_09_signal_parity", """
SELECT count(*) AS n_checks, count(CASE WHEN s1 <> s2 THEN 1 END) AS n_mismatches, count(*) > 0 AND count(CASE WHEN s1 <> s2 THEN 1 END) = 0 AS passed FROM (
 SELECT CAST(coalesce(sign(ret_1d), 0) AS INTEGER) AS s1, CASE WHEN volume > 50000 THEN 0 ELSE CAST(coalesce(sign(ret_1d), 0) AS INTEGER) END AS s2 FROM px_ret)""")
def _(t):
    a = t.bars().withColumn("signal", rep.sign_signal(win.pct_change("close", 1)))
    b = a.withColumn("signal", F.when(F.col("volume") > 50000, 0).otherwise(F.col("signal")))
    return gat.signal_parity(a, b, ["symbol", "ts"])


@query("gat_11_single_strategy_parity", f"WITH {_SIGS} SELECT count(*) AS n_checks, 0::BIGINT AS n_mismatches, count(*) > 0 AS passed FROM sg JOIN pr USING (symbol)")
def _(t):
    sig = daily_signals(t)
    one = sig.select("symbol", F.lit("only").alias("strategy"), F.lit(1e6).alias("budget"), F.lit(1).alias("n_symbols"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("max_position"))
    net = od.net_targets(od.size_equal_weight(one, sig, last_prices(t)))
    return gat.signal_parity(sig.select("symbol", F.col("target").alias("signal")), net.select("symbol", F.col("target").alias("signal")), ["symbol"])


_ENTRY = """SELECT symbol AS g, ts, open, volume, 1 AS signal, 0.005::DOUBLE AS fee, 5.0 / 10000 AS slip, 1.0::DOUBLE AS cap FROM bars"""


@query("gat_10_sizing_reconciliation", f"""WITH RECURSIVE {replay_ctes(_ENTRY)},
a AS (SELECT g AS symbol, arg_min(shares * entry_price, ts) AS a_notional FROM tr GROUP BY 1),
b AS (SELECT symbol, trunc(100000 / (open * 1.0005)) * (open * 1.0005) AS b_notional FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) = 2)
SELECT symbol, {r6('a_notional','a_notional',2)}, {r6('b_notional','b_notional',2)}, {r6('b_notional / a_notional - 1','relative_delta')}, abs(b_notional / a_notional - 1) <= 0.01 AS passed FROM a JOIN b USING (symbol)""")
def _(t):
    bars = t.bars()
    tr = rep.trades(rep.replay(bars.withColumn("signal", F.lit(1)), ["symbol"], rep.Costs(0.005, 5.0, 1.0)), ["symbol"])
    second = bars.withColumn("n", F.row_number().over(win.per("symbol"))).where("n = 2")
    fill = od.fill_price(F.col("open"), F.lit(1), 5.0)
    b = second.select("symbol", (od.whole_shares(F.lit(100000.0), fill) * fill).alias("notional"))
    out = gat.sizing_reconciliation(od.first_entry_notional(tr), b)
    return out.select("symbol", r("a_notional", "a_notional", 2), r("b_notional", "b_notional", 2), r("relative_delta", "relative_delta"), "passed")


# --- freshness ------------------------------------------------------------------------------
NOW = "2001-07-03 12:00:00"
_REQ = f"""s AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM bars WHERE ts <= TIMESTAMP '{NOW}'),
lt AS (SELECT symbol AS name, max(ts) AS latest FROM bars WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1),
sl AS (SELECT 'S' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN 'price_deadline' WHEN 1 THEN 'fred_release' WHEN 2 THEN 'liveness_trading' ELSE 'liveness_calendar' END AS kind, CAST(s_suppkey % 5 AS INTEGER) AS n FROM supplier),
wk AS (SELECT CAST(d AS DATE) AS day, row_number() OVER (ORDER BY d DESC) AS i FROM generate_series(DATE '2001-01-01', DATE '2001-07-03', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5),
rq AS (SELECT name, kind, CASE kind WHEN 'price_deadline' THEN (SELECT max(session) FROM s WHERE session + INTERVAL 1 DAY + INTERVAL 6 HOURS <= TIMESTAMP '{NOW}')
  WHEN 'fred_release' THEN (SELECT day FROM wk WHERE i = n + 2) WHEN 'liveness_trading' THEN (SELECT session FROM (SELECT session, row_number() OVER (ORDER BY session DESC) AS k FROM s) WHERE k = n + 1)
  ELSE DATE '2001-07-03' - n END AS required_date FROM sl),
fs AS (SELECT rq.*, latest, CASE WHEN latest IS NULL THEN 'missing' WHEN CAST(latest AS DATE) >= required_date THEN 'fresh' ELSE 'stale' END AS state FROM rq LEFT JOIN lt USING (name))"""


def statuses(t):
    k, now = F.col("s_suppkey"), F.lit(NOW).cast("timestamp")
    kind = F.when(k % 4 == 0, "price_deadline").when(k % 4 == 1, "fred_release").when(k % 4 == 2, "liveness_trading").otherwise("liveness_calendar")
    n = (k % 5).cast("int")
    slas = t.raw("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), kind.alias("kind"), F.lit(1).alias("deadline_day_offset"),
                                    F.lit(6).alias("deadline_hour_utc"), n.alias("lag"), n.alias("max_stale_days"))
    bars = tj.pit_panel(t.bars(), NOW)
    latest = bars.groupBy(F.col("symbol").alias("name")).agg(F.max("ts").alias("latest"))
    return mon.feed_status(mon.required_dates(slas, dt.sessions_of(bars), now), latest)


@query("mon_01_feed_status", f"WITH {_REQ} SELECT name, kind, CAST(required_date AS VARCHAR) AS required_date, latest, state FROM fs")
def _(t):
    return statuses(t).select("name", "kind", F.col("required_date").cast("string").alias("required_date"), "latest", "state")


@query("gat_12_freshness_gate", f"""WITH {_REQ}, x AS (SELECT *, CASE WHEN kind = 'fred_release' THEN 'fresh' ELSE state END AS expected FROM fs)
SELECT count(CASE WHEN expected = 'fresh' AND state <> 'fresh' THEN 1 END) AS false_stale, count(CASE WHEN expected <> 'fresh' AND state = 'fresh' THEN 1 END) AS missed_stale, count(*) AS n_cases,
 count(CASE WHEN (expected = 'fresh') <> (state = 'fresh') THEN 1 END) = 0 AS passed FROM x""")
def _(t):
    labelled = statuses(t).withColumn("expected", F.when(F.col("kind") == "fred_release", "fresh").otherwise(F.col("state")))
    return mon.freshness_gate(labelled)


@query("mon_06_age_status", f"""
SELECT name, age_days, CASE WHEN age_days <= 4 THEN 'fresh' ELSE 'stale' END AS status FROM (
 SELECT symbol AS name, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 86400000000.0::DOUBLE, 2) AS age_days FROM bars WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1)""")
def _(t):
    latest = tj.pit_panel(t.bars(), NOW).groupBy(F.col("symbol").alias("name")).agg(F.max("ts").alias("latest"))
    return mon.age_status(latest, F.lit(NOW).cast("timestamp")).select("name", "age_days", "status")


@query("mon_12_missing_series", "SELECT DISTINCT p_brand AS series_id FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || l_linenumber FROM lineitem)")
def _(t):
    expected = t.raw("part").select(F.col("p_brand").alias("series_id")).distinct()
    present = t.raw("lineitem").select(F.concat(F.lit("Brand#"), "l_linenumber").alias("series_id"))
    return mon.missing_series(expected, present)


@query("mon_13_source_spans", "SELECT source, lang, count(*) AS n_rows, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY 1, 2")
def _(t):
    return t.raw("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_rows"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


# --- drift ----------------------------------------------------------------------------------
#: All registered columns, and one that stopped being delivered.
DRIFT = [*feat.ALL_COLUMNS, "old_vol"]


def monitored(t):
    """The columns of ``full_features`` and ``old_vol``, in two tables: a column's drift needs no other column, so ranks stay as
    they come out of their days, and what follows from the day or the row is not written but computed at each reading."""
    own = materialized(feat.build_features(t.bars().select("symbol", "ts", "close", "volume"), docs=t.docs(), start=START, end=END, daily=True).select(
        "symbol", "ts", *feat.PRICE_COLUMNS, *feat.DOCUMENT_COLUMNS))
    ranks = materialized(percent_rank_columns(own.select("symbol", "ts", *feat.RANKED), feat.RANKED, rows=own).select(
        "ts", *[f"xs_rank_{c}" for c in feat.RANKED]))
    whole = feat.regime_flags(feat.with_macro(own, t.once("macro", t.macro), START, END))
    return [whole.withColumns({"old_vol": F.when(F.col("ts") < "1998-06-01", F.col("vol_21d")), "has_coverage": F.col("has_coverage").cast("double")}), ranks]


_PSI = f"""
mf AS (SELECT *, CASE WHEN ts < TIMESTAMP '1998-06-01' THEN vol_21d END AS old_vol FROM full_feat),
tl AS (SELECT CAST(ts AS DATE) AS day, unnest({DRIFT}) AS feature, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in DRIFT)}]) AS x FROM mf),
vd AS (SELECT feature, day, row_number() OVER (PARTITION BY feature ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY feature) AS n_dates FROM (SELECT DISTINCT feature, day FROM tl WHERE x IS NOT NULL)),
sp AS (SELECT tl.feature, tl.day, x, k <= 252 AS rec, n_dates FROM tl JOIN vd ON vd.feature = tl.feature AND vd.day = tl.day WHERE x IS NOT NULL),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM sp WHERE NOT rec GROUP BY 1),
bn AS (SELECT feature, len(list_filter(e[2:-2], lambda v: v <= x)) AS b, rec FROM sp JOIN ed USING (feature) WHERE len(e) >= 2),
ct AS (SELECT feature, b, count(CASE WHEN rec THEN 1 END) AS r, count(CASE WHEN NOT rec THEN 1 END) AS o FROM bn GROUP BY 1, 2),
pc AS (SELECT feature, r / sum(r) OVER (PARTITION BY feature) AS r, o / sum(o) OVER (PARTITION BY feature) AS o FROM ct),
en AS (SELECT feature, count(CASE WHEN rec THEN 1 END) >= 50 AND count(CASE WHEN NOT rec THEN 1 END) >= 50 AND max(n_dates) > 253 AS enough FROM sp GROUP BY 1),
p0 AS (SELECT feature, sum((r - o) * ln(r / o)) AS psi FROM (SELECT feature, CASE WHEN r = 0 THEN 0.0001 ELSE r END AS r, CASE WHEN o = 0 THEN 0.0001 ELSE o END AS o FROM pc) GROUP BY 1),
ps AS (SELECT en.feature, CASE WHEN enough THEN psi END AS psi FROM en LEFT JOIN p0 USING (feature)),
bd AS (SELECT feature, day, rec, avg(x) AS m FROM sp GROUP BY 1, 2, 3),
sh AS (SELECT feature, abs(avg(CASE WHEN rec THEN m END) - avg(CASE WHEN NOT rec THEN m END)) AS shift, stddev_samp(CASE WHEN NOT rec THEN m END) AS sd FROM bd GROUP BY 1),
st AS (SELECT feature, count(*) AS n_rows, count(x) / count(*) AS coverage, avg(x) AS mean, stddev_samp(x) AS std, max(CASE WHEN x IS NOT NULL THEN day END) AS last_valid, min(x) AS lo, max(x) AS hi FROM tl GROUP BY 1),
bh AS (SELECT feature, count(DISTINCT day) AS behind FROM tl JOIN st USING (feature) WHERE day > last_valid GROUP BY 1),
fs AS (SELECT st.*, psi, CASE WHEN last_valid IS NULL OR coalesce(behind, 0) > 21 THEN 'stale' WHEN (n_dates > 253 AND CASE WHEN coalesce(sd, 0) = 0 THEN shift > 0 ELSE shift / sd >= 1 END) OR psi >= 0.25 THEN 'drifting' ELSE 'stable' END AS verdict
  FROM st LEFT JOIN sh USING (feature) LEFT JOIN ps USING (feature) LEFT JOIN bh USING (feature) LEFT JOIN (SELECT feature, max(n_dates) AS n_dates FROM vd GROUP BY 1) USING (feature)),
hb AS (SELECT feature, CASE WHEN hi = lo THEN 10 ELSE least(CAST(floor((x - lo) / (hi - lo) * 20) AS BIGINT), 19) END AS bar, count(*) AS n FROM tl JOIN st USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2),
hd AS (SELECT s.feature, array_to_string(list(coalesce(n, 0) ORDER BY k), ',') AS distribution FROM (SELECT feature, unnest(range(20)) AS k FROM st) s LEFT JOIN hb ON hb.feature = s.feature AND hb.bar = s.k GROUP BY 1)"""


@query("mon_08_drift_psi", f"WITH {_PSI} SELECT feature, {r6('psi','psi')} FROM ps")
def _(t):
    return mon.drift_psi(monitored(t), DRIFT).select("feature", r("psi", "psi"))


# A moving window's result may differ in its last bits between equal inputs at different places, so
# values that are equal would tie or not by chance: they are compared to 12 digits.
_MOVING = ("vol_21d", "vol_63d", "rsi_14", "ma200_ratio", "ma50_ratio", "volume_ratio", "vol_regime_ratio", "sentiment_score")
_EVEN = f"""ev AS (SELECT * EXCLUDE (xs_rank_vol_21d) REPLACE ({', '.join(f'round({c}, 12) AS {c}' for c in _MOVING)}) FROM full_feat),
even_feat AS (SELECT f.*, {_RANK.format(c='vol_21d')} FROM ev f)"""


@query("mon_10_feature_stats", f"""WITH {_EVEN}, {_PSI.replace('FROM full_feat', 'FROM even_feat')}
SELECT feature, n_rows, {r6('coverage','coverage')}, {r6('mean','mean')}, {r6('std','std')}, {r6('psi','psi')}, distribution, verdict FROM fs JOIN hd USING (feature)""")
def _(t):
    out = mon.feature_stats(monitored(t), DRIFT)
    return out.select("feature", "n_rows", *[r(c, c) for c in ("coverage", "mean", "std", "psi")],
                      F.concat_ws(",", F.transform("distribution", lambda n: n.cast("string"))).alias("distribution"), "verdict")


# --- report views ---------------------------------------------------------------------------
@query("tab_05_roster", f"""
WITH m AS ({metrics_sql('rets', 'run')}), v AS (SELECT 'S' || s_suppkey AS run, CASE WHEN s_acctbal > 0 THEN 'passed' ELSE 'failed' END AS verdict FROM supplier WHERE s_nationkey <> 3),
g AS (SELECT run, ts, product(1 + ret) OVER (PARTITION BY run ORDER BY ts) AS g, row_number() OVER (PARTITION BY run ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY run) AS c FROM rets),
s AS (SELECT run, array_to_string(list(CAST(CAST(round(g * 1000) AS BIGINT) AS VARCHAR) ORDER BY ts), ',') AS spark FROM g WHERE c <= 20 OR i IN (SELECT CAST(round_even(k * ((m2.c - 1) / 19.0::DOUBLE), 0) AS BIGINT) FROM range(20) t(k), (SELECT g.c AS c) m2) GROUP BY 1)
SELECT run, sharpe, max_drawdown, coalesce(verdict, 'unknown') AS verdict, spark FROM m LEFT JOIN v USING (run) LEFT JOIN s USING (run)""")
def _(t):
    ret = t.returns()
    verdicts = t.raw("supplier").where("s_nationkey <> 3").select(F.concat(F.lit("S"), "s_suppkey").alias("run"), F.when(F.col("s_acctbal") > 0, "passed").otherwise("failed").alias("verdict"))
    out = rpt.roster(met.return_metrics(ret, ["run"]), verdicts, rpt.spark_line(ret, 20))
    line = F.concat_ws(",", F.transform("spark", lambda g: F.round(g * 1000, 0).cast("bigint").cast("string")))
    return out.select("run", r("sharpe", "sharpe"), r("max_drawdown", "max_drawdown"), "verdict", line.alias("spark"))


@query("tab_07_conditions", f"""WITH {AXES_CTES}, la AS (SELECT * FROM ({AXES_SQL}) WHERE condition IS NOT NULL)
SELECT run, axis, condition, {r6('CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END','sharpe')}, count(*) AS n_bars FROM rets JOIN la USING (ts) GROUP BY 1, 2, 3""")
def _(t):
    out = rpt.sharpe_by_condition(t.returns(), axes(t))
    return out.select("run", "axis", "condition", r("sharpe", "sharpe"), "n_bars")


STRESS = (("crisis_a", "1997-07-01", "1998-10-31"), ("crisis_b", "1998-08-01", "1999-02-28"), ("crisis_c", "2000-03-01", "2001-09-30"))


@query("met_15_stress_windows", f"""
WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in STRESS)}) t("window", lo, hi))
SELECT run, "window", {r6('CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END','sharpe')}, count(*) AS n_bars FROM rets JOIN w ON CAST(ts AS DATE) BETWEEN lo AND hi GROUP BY 1, 2""")
def _(t):
    return rpt.stress_windows(t.returns(), STRESS).select("run", "window", r("sharpe", "sharpe"), "n_bars")


_TRIALS = """tr AS (SELECT 'ledger-2001-01-01-' || printf('%04d', o_orderkey) AS id, sha1(CAST(o_custkey AS VARCHAR)) AS config_hash, o_custkey % 5 + 1 AS n_comparisons,
  CASE WHEN o_orderstatus <> 'P' THEN (o_totalprice - 250000) / 200003 END AS sharpe, o_orderdate AS started_at, o_orderpriority AS agent, o_orderstatus AS st FROM orders)"""


def trials(t):
    return t.raw("orders").select(
        F.concat(F.lit("ledger-2001-01-01-"), F.format_string("%04d", "o_orderkey")).alias("id"), F.sha1(F.col("o_custkey").cast("string")).alias("config_hash"),
        (F.col("o_custkey") % 5 + 1).alias("n_comparisons"), F.when(F.col("o_orderstatus") != "P", (F.col("o_totalprice") - 250000) / 200003).alias("sharpe"),
        F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("agent"), F.col("o_orderstatus").alias("st"))


@query("tab_10_trial_view", f"""WITH {_TRIALS} SELECT agent, CAST(sum(n_comparisons) AS BIGINT) AS n_trials, {r6('max(sharpe)','best_sharpe')}, {r6('stddev_samp(sharpe)','sharpe_std')} FROM tr GROUP BY 1""")
def _(t):
    return rpt.trial_view(trials(t), ["agent"]).select("agent", "n_trials", r("best_sharpe", "best_sharpe"), r("sharpe_std", "sharpe_std"))


@query("tab_10_luck_bar", f"""
WITH RECURSIVE {_TRIALS}, mo AS (SELECT agent, date_trunc('month', started_at) AS month, CAST(sum(n_comparisons) AS BIGINT) AS n, max(sharpe) AS s FROM tr GROUP BY 1, 2),
ru AS (SELECT agent, month, CAST(sum(n) OVER w AS BIGINT) AS n_trials, stddev_samp(s) OVER w AS sd, max(s) OVER w AS best FROM mo WINDOW w AS (PARTITION BY agent ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ns AS (SELECT DISTINCT n_trials AS n FROM ru), {MAX_SHARPE}
SELECT agent, CAST(CAST(month AS DATE) AS VARCHAR) AS month, n_trials, {r6('best','best_sharpe')}, {r6('sd * unit_max','luck_bar')}, coalesce(best > sd * unit_max, false) AS beats_luck FROM ru JOIN ms ON ms.n = ru.n_trials""")
def _(t):
    """One ledger row per agent and month."""
    monthly = trials(t).groupBy("agent", F.date_trunc("month", "started_at").alias("month")).agg(F.sum("n_comparisons").alias("n_comparisons"), F.max("sharpe").alias("sharpe"))
    out = rpt.luck_bar(monthly, ["agent"], ["month"])
    return out.select("agent", F.to_date("month").cast("string").alias("month"), "n_trials", r("best_sharpe", "best_sharpe"), r("luck_bar", "luck_bar"), "beats_luck")


@query("jon_22_trial_commits", f"""WITH {_TRIALS} SELECT id, CASE WHEN c_custkey % 3 <> 0 THEN sha1('c' || c_custkey) END AS "commit" FROM tr LEFT JOIN customer ON sha1(CAST(c_custkey AS VARCHAR)) = config_hash""")
def _(t):
    k = F.col("c_custkey").cast("string")
    runs = t.raw("customer").select(F.sha1(k).alias("config_hash"), F.when(F.col("c_custkey") % 3 != 0, F.sha1(F.concat(F.lit("c"), k))).otherwise("dirty").alias("git_sha"))
    return rpt.with_commit(trials(t), runs).select("id", "commit")


@query("jon_21_run_verdicts", f"""WITH {_TRIALS}, v AS (SELECT sha1(CAST(c_custkey AS VARCHAR)) AS config_hash, c_mktsegment AS verdict FROM customer WHERE c_acctbal > 0)
SELECT id, coalesce(verdict, 'unknown') AS verdict FROM tr LEFT JOIN v USING (config_hash)""")
def _(t):
    v = t.raw("customer").where("c_acctbal > 0").select(F.sha1(F.col("c_custkey").cast("string")).alias("config_hash"), F.col("c_mktsegment").alias("verdict"))
    return trials(t).join(v, "config_hash", "left").select("id", F.coalesce("verdict", F.lit("unknown")).alias("verdict"))


@query("tab_14_trial_append", f"""WITH {_TRIALS}, ex AS (SELECT * FROM tr WHERE st = 'F'), nw AS (SELECT config_hash, min(started_at) AS started_at FROM tr WHERE st <> 'F' AND config_hash NOT IN (SELECT config_hash FROM ex) GROUP BY 1)
SELECT config_hash, started_at, 'ledger-2001-01-01-' || printf('%04d', (SELECT max(CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT)) FROM ex) + row_number() OVER (ORDER BY config_hash)) AS id FROM nw""")
def _(t):
    tr = trials(t)
    return rpt.append_trials(tr.where("st = 'F'"), tr.where("st <> 'F'"), "2001-01-01").select("config_hash", "started_at", "id")


@query("jon_19_unrecorded_configurations", f"""WITH {_TRIALS} SELECT DISTINCT config_hash FROM tr WHERE st <> 'F' AND config_hash NOT IN (SELECT config_hash FROM tr WHERE st = 'F')""")
def _(t):
    tr = trials(t)
    return tr.where("st <> 'F'").select("config_hash").distinct().join(tr.where("st = 'F'").select("config_hash"), "config_hash", "left_anti")


@query("tab_11_market_snapshot", f"""SELECT {', '.join(r6(f"arg_max(value, \"timestamp\") FILTER (WHERE series_id = '{s}')", s) for s in feat.MACRO_SERIES)} FROM macro""")
def _(t):
    m = t.macro()
    return m.agg(*[r(F.max_by("value", F.when(F.col("series_id") == s, F.col("timestamp"))), s) for s in feat.MACRO_SERIES])


@query("tab_12_allocation", f"""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'enabled' ELSE 'idle' END AS state, {r6('CASE WHEN s_acctbal > 0 THEN 100.0 / count(CASE WHEN s_acctbal > 0 THEN 1 END) OVER () ELSE 0 END','allocation_pct')} FROM supplier""")
def _(t):
    reg = t.raw("supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("enabled"))
    return rpt.allocation(reg).select("s_suppkey", "state", r("allocation_pct", "allocation_pct"))


@query("tab_13_fanout", """
WITH a AS (SELECT DISTINCT symbol AS run FROM bars), b AS (SELECT DISTINCT symbol AS run FROM docs), c AS (SELECT 'S' || s_suppkey AS run FROM supplier WHERE s_acctbal > 0),
u AS (SELECT run FROM a UNION SELECT run FROM b UNION SELECT run FROM c)
SELECT run, a.run IS NOT NULL AS in_roster, b.run IS NOT NULL AS in_detail, c.run IS NOT NULL AS in_provenance, a.run IS NOT NULL AND b.run IS NOT NULL AND c.run IS NOT NULL AS complete
FROM u LEFT JOIN a USING (run) LEFT JOIN b USING (run) LEFT JOIN c USING (run)""")
def _(t):
    a, b = t.bars().select(F.col("symbol").alias("run")), t.docs().select(F.col("symbol").alias("run"))
    c = t.raw("supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("run"))
    return rpt.fanout(a, b, c)


#: Names of a catalog with one entry per part.
CATALOG = ("ret_5d", "vol_21d", "rsi_14", "xs_rank_vol_21d", "VIXCLS", "doc_count", "old_vol", "trend_regime")
CATALOG_SQL = "CASE p_size % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATALOG)) + " ELSE 'none' END"


def catalog(t):
    named = F.get(F.array(*[F.lit(c) for c in CATALOG]), (F.col("p_size") % 12).cast("int"))
    return t.raw("part").select("p_partkey", F.coalesce(named, F.lit("none")).alias("name"))


@query("tab_09_catalog_view", f"""WITH {_PSI}
SELECT p_partkey, name, {r6('coverage','coverage')}, coalesce(verdict, 'unmeasured') AS verdict FROM (SELECT p_partkey, {CATALOG_SQL} AS name FROM part) f LEFT JOIN fs ON fs.feature = f.name""")
def _(t):
    stats = mon.feature_stats(monitored(t), DRIFT).select("feature", "coverage", "verdict")
    return rpt.catalog_view(catalog(t), stats).select("p_partkey", "name", r("coverage", "coverage"), "verdict")


@query("tab_08_provenance", """
SELECT p_partkey, array_to_string(list_filter(['prices', CASE WHEN p_size % 3 = 0 THEN 'macro' END, CASE WHEN p_size % 5 = 0 THEN 'documents' END, CASE WHEN p_size % 7 = 0 THEN 'cross_section' END], lambda x: x IS NOT NULL), ',') AS lineage, CAST(504 AS BIGINT) AS train_window, p_size AS test_window FROM part""")
def _(t):
    s = F.col("p_size")
    cols = F.array_compact(F.array(F.when(s % 2 == 0, "ret_5d"), F.when(s % 3 == 0, "VIXCLS"), F.when(s % 5 == 0, "doc_count"), F.when(s % 7 == 0, "xs_rank_vol_21d")))
    config = F.to_json(F.struct(F.struct(s.alias("test_window")).alias("walk_forward")))
    p = t.raw("part").select("p_partkey", cols.alias("cols"), config.alias("cfg"))
    parsed = p.withColumn("c", F.from_json("cfg", "walk_forward struct<train_window:bigint,test_window:int>"))
    return parsed.select("p_partkey", F.concat_ws(",", rpt.lineage(F.col("cols"))).alias("lineage"),
                         F.coalesce("c.walk_forward.train_window", F.lit(504)).cast("bigint").alias("train_window"), F.col("c.walk_forward.test_window").alias("test_window"))


@query("str_11_verdict_phrases", f"""
SELECT run, CASE WHEN sharpe > 0 THEN 'Sharpe ' || CASE WHEN sharpe > 1 THEN 'strong' ELSE 'weak' END ELSE 'Sharpe negative' END AS phrase FROM ({metrics_sql('rets', 'run')})""")
def _(t):
    s = F.col("sharpe")
    m = met.return_metrics(t.returns(), ["run"])
    phrase = F.when(s > 0, F.format_string("Sharpe %s", F.when(s > 1, "strong").otherwise("weak"))).otherwise("Sharpe negative")
    return m.select("run", phrase.alias("phrase"))


@query("exe_09_cycle_table", f"""WITH {_SIZED} SELECT symbol, target, shares, (SELECT CASE WHEN max(ts) IS NULL THEN 'missing' WHEN (epoch(TIMESTAMP '{ASOF}') - epoch(max(ts))) / 86400 <= 4 THEN 'fresh' ELSE 'stale' END FROM bars WHERE ts <= TIMESTAMP '{ASOF}') AS feed_state FROM nx""")
def _(t):
    asof = F.lit(ASOF).cast("timestamp")
    latest = tj.pit_panel(t.bars(), ASOF).agg(F.max("ts").alias("latest")).withColumn("name", F.lit("bars"))
    feed = mon.age_status(latest, asof).select(F.lit(1).alias("_k"), F.col("status").alias("feed_state"))
    net = od.net_targets(sized(t)).withColumn("_k", F.lit(1))
    return net.join(feed, "_k").select("symbol", "target", "shares", "feed_state")


# --- a cycle on callables -------------------------------------------------------------------
@query("udf_07_cycle_callables", f"""WITH {_UNI},
sg AS (SELECT symbol, CAST(coalesce(sign(arg_max(m, ts)), 0) AS INTEGER) AS target FROM (SELECT symbol, ts, coalesce("close" / lag("close", 5) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS m FROM bars WHERE ts <= TIMESTAMP '{ASOF}') GROUP BY 1),
pr AS (SELECT symbol, arg_max((high + low) / 2, ts) AS price FROM bars WHERE ts <= TIMESTAMP '{ASOF}' GROUP BY 1),
u2 AS (SELECT * REPLACE (budget * CASE WHEN n_live >= 2 THEN 1.0 ELSE 0.5 END AS budget) FROM (SELECT un.*, count(pr.price) OVER (PARTITION BY strategy) AS n_live FROM un LEFT JOIN pr USING (symbol))),
sz AS (SELECT u2.*, sg.target, price * (1 + sg.target * 5.0 / 10000) AS fill, CASE WHEN sg.target <> 0 THEN sg.target * trunc(budget / n_symbols / (price * (1 + sg.target * 5.0 / 10000))) ELSE 0 END AS shares FROM u2 JOIN sg USING (symbol) JOIN pr USING (symbol)),
nt AS (SELECT symbol, sign(sum(weight * target)) AS d, sum(shares) AS s, sum(shares * fill) AS n, min(max_position) AS cap FROM sz GROUP BY 1)
SELECT symbol, CAST(CASE WHEN abs(d) <= cap THEN d ELSE 0 END AS INTEGER) AS target, CASE WHEN abs(d) <= cap AND d <> 0 THEN abs(s) ELSE 0 END::DOUBLE AS shares, {r6('CASE WHEN abs(d) <= cap AND d <> 0 THEN n ELSE 0 END','notional',2)} FROM nt""")
def _(t):
    """Momentum for the signal, the middle of the last bar for the price, half the budget where fewer than two symbols trade."""
    from pyspark.sql import Window

    def signal(asof):
        h = tj.pit_panel(t.bars(), asof).withColumn("m", F.coalesce(win.pct_change("close", 5), F.lit(0.0)))
        return h.groupBy("symbol").agg(od.target_position(F.max_by("m", "ts")).alias("target"))

    def price(asof):
        return tj.pit_panel(t.bars(), asof).groupBy("symbol").agg(F.max_by((F.col("high") + F.col("low")) / 2, "ts").alias("price"))

    def capital(un, asof):
        live = un.join(price(asof).select("symbol", F.lit(1).alias("_live")), "symbol", "left")
        n = F.count("_live").over(Window.partitionBy("strategy"))
        return live.withColumn("budget", F.col("budget") * F.when(n >= 2, 1.0).otherwise(0.5)).drop("_live")

    out = od.run_cycle(universe(t), od.Cycle(signal, price, capital), ASOF)
    return out.select("symbol", "target", "shares", r("notional", "notional", 2))
