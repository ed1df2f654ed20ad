"""Time-join, date and equi-join queries."""
from pyspark.sql import functions as F

from tidemark.functions import dates as dt
from tidemark.operators import features as feat
from tidemark.operators import labels as lab
from tidemark.operators import timejoin as tj
from tidemark.operators import windows as win
from tidemark.operators.ranks import competition_rank
from tidemark.plans.oracle_ctes import gated
from tidemark.plans.registry import query, r6
from tidemark.plans.stats_q import scheme_predictions
from tidemark.sources import checks

START, END = "1995-01-01", "2001-12-31"


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


# --- as-of ----------------------------------------------------------------------------------
@query("jon_01_asof_backward", f"""
SELECT d.document_id, d.symbol, d.published_at, b.ts AS bar_ts, {r6('b."close"','"close"')}
FROM docs d ASOF LEFT JOIN bars b ON d.symbol = b.symbol AND d.published_at >= b.ts""")
def _(t):
    bars = t.bars().select("symbol", F.col("ts").alias("bar_ts"), "close")
    out = tj.asof_join(t.docs(), bars, ["symbol"], "published_at", "bar_ts", ["close"])
    return out.select("document_id", "symbol", "published_at", F.col("asof_bar_ts").alias("bar_ts"), r("close", "close"))


@query("jon_03_unlagged_macro", f"""
WITH m AS (SELECT day, last_value(v IGNORE NULLS) OVER (ORDER BY day) AS v FROM calendar_days LEFT JOIN (
  SELECT CAST("timestamp" AS DATE) AS day, max(value) AS v FROM macro WHERE series_id = 'DGS10' GROUP BY 1) USING (day))
SELECT symbol, ts, {r6('m.v','DGS10')} FROM bars b LEFT JOIN m ON m.day = CAST(b.ts AS DATE)""")
def _(t):
    out = tj.attach_macro(t.bars(), t.macro(), ["DGS10"], START, END, None)
    return out.select("symbol", "ts", r("DGS10", "DGS10"))


@query("jon_04_pit_latest_bar", f"""
SELECT symbol, ts, {r6('"close"','"close"')} FROM bars WHERE ts <= TIMESTAMP '1999-06-30 12:00:00'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def _(t):
    return tj.pit_latest(t.bars(), "1999-06-30 12:00:00").select("symbol", "ts", r("close", "close"))


@query("jon_05_pit_panel", f"""SELECT symbol, ts, {r6('"close"','"close"')} FROM bars
WHERE ts <= TIMESTAMP '1999-06-30 12:00:00' AND symbol IN ('S1', 'S2', 'S3', 'S5', 'S8')""")
def _(t):
    return tj.pit_panel(t.bars(), "1999-06-30 12:00:00", ["S1", "S2", "S3", "S5", "S8"]).select("symbol", "ts", r("close", "close"))


_ASKS = "SELECT o_orderkey, 'S' || (o_custkey // 3) AS symbol, o_orderdate + INTERVAL 14 HOURS AS asof FROM orders"


def asks(t):
    return t.raw("orders").select("o_orderkey", F.concat(F.lit("S"), F.floor(F.col("o_custkey") / 3)).alias("symbol"),
                                  (F.col("o_orderdate") + F.expr("INTERVAL 14 HOURS")).alias("asof"))


@query("jon_06_asof_sweep", f"""
SELECT a.o_orderkey, a.symbol, a.asof, b.ts AS bar_ts FROM ({_ASKS}) a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.asof >= b.ts""")
def _(t):
    bars = t.bars().select("symbol", F.col("ts").alias("bar_ts"))
    out = tj.asof_join(asks(t), bars, ["symbol"], "asof", "bar_ts", [])
    return out.select("o_orderkey", "symbol", "asof", F.col("asof_bar_ts").alias("bar_ts"))


@query("val_12_no_look_ahead_gate", f"""
SELECT count(*) AS n_checks, CAST(count(CASE WHEN bar_ts > a_of THEN 1 END) AS BIGINT) AS n_violations, count(CASE WHEN bar_ts > a_of THEN 1 END) = 0 AS passed FROM (
SELECT a.asof AS a_of, b.ts AS bar_ts FROM ({_ASKS}) a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.asof >= b.ts)""")
def _(t):
    bars = t.bars().select("symbol", F.col("ts").alias("bar_ts"))
    out = tj.asof_join(asks(t), bars, ["symbol"], "asof", "bar_ts", []).drop("bar_ts")
    return checks.look_ahead_gate(out.withColumnRenamed("asof_bar_ts", "bar_ts"))


@query("jon_24_first_bar_after", """
SELECT d.document_id, d.symbol, d.published_at, min(b.ts) AS first_bar FROM docs d LEFT JOIN bars b ON b.symbol = d.symbol AND b.ts > d.published_at
GROUP BY 1, 2, 3""")
def _(t):
    out = tj.first_bar_after(t.docs(), t.bars())
    return out.select("document_id", "symbol", "published_at", F.col("asof_bar_ts").alias("first_bar"))


@query("val_09_point_in_time_audit", """
SELECT count(*) AS n_pairs, CAST(count(CASE WHEN published_at >= first_bar THEN 1 END) AS BIGINT) AS n_violations FROM (
SELECT d.published_at, min(b.ts) AS first_bar FROM docs d JOIN bars b ON b.symbol = d.symbol AND b.ts > d.published_at GROUP BY d.document_id, d.published_at)""")
def _(t):
    out = tj.first_bar_after(t.docs(), t.bars()).where("asof_bar_ts IS NOT NULL")
    return checks.point_in_time_audit(out.withColumnRenamed("asof_bar_ts", "bar_ts"))


@query("jon_17_market_on_dates", f"""
WITH m AS (SELECT day, last_value(v IGNORE NULLS) OVER (ORDER BY day) AS v FROM calendar_days LEFT JOIN (
  SELECT CAST("timestamp" AS DATE) AS day, max(value) AS v FROM macro WHERE series_id = 'VIXCLS' GROUP BY 1) USING (day))
SELECT d.ts, {r6('m.v','VIXCLS')} FROM (SELECT DISTINCT ts FROM bars) d LEFT JOIN m ON m.day = CAST(d.ts AS DATE)""")
def _(t):
    out = tj.attach_macro(t.bars().select("ts").distinct(), t.macro(), ["VIXCLS"], START, END)
    return out.select("ts", r("VIXCLS", "VIXCLS"))


# --- calendars and alignment ----------------------------------------------------------------
@query("jon_10_master_calendar", """
SELECT p.ts, p.pos, count(*) AS alive_symbols FROM positions p JOIN bars b USING (ts) GROUP BY 1, 2""")
def _(t):
    bars = t.bars()
    alive = bars.groupBy("ts").agg(F.count(F.lit(1)).alias("alive_symbols"))
    return tj.master_calendar(bars).join(alive, "ts")


@query("prj_08_complete_panel", f"""
SELECT f.symbol, f.ts, {r6('ret_21d','ret_21d')}, {r6('vol_63d','vol_63d')}, {r6('y','y')} FROM px_feat f JOIN (
  SELECT symbol, ts, lead("close", 5) OVER (PARTITION BY symbol ORDER BY ts) / "close" - 1 AS y FROM bars) l USING (symbol, ts)
WHERE ret_21d IS NOT NULL AND vol_63d IS NOT NULL AND y IS NOT NULL""")
def _(t):
    f = feat.price_features(t.bars()).select("symbol", "ts", "ret_21d", "vol_63d")
    y = t.bars().select("symbol", "ts", lab.forward_return(5).alias("y"))
    out = f.join(y, ["symbol", "ts"]).dropna()
    return out.select("symbol", "ts", r("ret_21d", "ret_21d"), r("vol_63d", "vol_63d"), r("y", "y"))


@query("val_18_key_alignment", """
WITH p AS (SELECT symbol, ts FROM bars), f AS (SELECT symbol, ts FROM px_feat WHERE vol_63d IS NOT NULL),
l AS (SELECT symbol, ts FROM (SELECT symbol, ts, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars) WHERE n IS NOT NULL),
a AS (SELECT p.symbol, p.ts, f.ts IS NOT NULL AS hf, l.ts IS NOT NULL AS hl FROM p LEFT JOIN f USING (symbol, ts) LEFT JOIN l USING (symbol, ts))
SELECT count(CASE WHEN NOT hf OR NOT hl THEN 1 END) AS prices_extra, count(CASE WHEN hf AND NOT hl THEN 1 END) AS features_extra,
  count(CASE WHEN hl AND NOT hf THEN 1 END) AS labels_extra FROM a""")
def _(t):
    bars = t.bars()
    f = feat.price_features(bars).where("vol_63d IS NOT NULL")
    y = bars.withColumn("y", lab.forward_return(5)).where("y IS NOT NULL")
    return checks.key_alignment({"prices": bars, "features": f, "labels": y}, ["symbol", "ts"])


_SETS = {"price": ["ret_5d", "vol_21d"], "trend": ["ret_5d", "ma200_ratio"], "long": ["ret_252d", "ma200_ratio", "vol_21d"]}


@query("val_19_feature_set_columns", f"""
WITH n AS (SELECT symbol, {', '.join(f'count({c}) AS {c}' for c in ('ret_5d', 'vol_21d', 'ma200_ratio', 'ret_252d'))} FROM px_feat GROUP BY 1),
u AS (SELECT symbol, feature, n FROM n UNPIVOT (n FOR feature IN (ret_5d, vol_21d, ma200_ratio, ret_252d)))
SELECT s.feature_set, u.symbol, u.feature, u.n AS n_values FROM u JOIN (VALUES {', '.join(f"('{k}', '{c}')" for k, v in _SETS.items() for c in v)}) s(feature_set, feature) ON s.feature = u.feature WHERE n < 280""")
def _(t):
    """Symbols whose history is too short for a column of a set."""
    return checks.missing_set_columns(feat.price_features(t.bars()), _SETS, least=280)


@query("jon_13_align_second_predictions", f"""
SELECT symbol, ts, {r6('a','pred_a')}, {r6('CASE WHEN b > 0 THEN b END','pred_b')} FROM (
  SELECT symbol, ts, "close" / lag("close", 5) OVER w - 1 AS a, "close" / lag("close", 21) OVER w - 1 AS b FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE a IS NOT NULL""")
def _(t):
    f = feat.price_features(t.bars())
    base = f.where("ret_5d IS NOT NULL").select("symbol", "ts", F.col("ret_5d").alias("pred_a"))
    other = f.where("ret_21d > 0").select("symbol", "ts", F.col("ret_21d").alias("pred_b"))
    return base.join(other, ["symbol", "ts"], "left").select("symbol", "ts", r("pred_a", "pred_a"), r("pred_b", "pred_b"))


@query("jon_14_align_series", f"""
SELECT p.scheme, p.symbol, p.ts, {r6('p.y_pred','y_pred')}, {r6('v.vol_21d','vol_21d')} FROM scheme_pred p
LEFT JOIN (SELECT symbol, ts, {gated('stddev_samp', 'ret_1d', 21)} AS vol_21d FROM px_ret) v ON v.symbol = p.symbol AND v.ts = p.ts""")
def _(t):
    """Each symbol's trailing volatility beside every prediction row; rows without one keep NULL."""
    series = feat.price_features(t.bars()).where("vol_21d IS NOT NULL").select("symbol", "ts", "vol_21d")
    out = tj.align_series(scheme_predictions(t), series)
    return out.select("scheme", "symbol", "ts", r("y_pred", "y_pred"), r("vol_21d", "vol_21d"))


@query("jon_15_pair_returns_on_dates", f"""
SELECT a.run, count(*) AS n_common, {r6('avg(a.ret - b.ret)','mean_delta')} FROM rets a JOIN rets b ON a.ts = b.ts AND b.run = 'S1' WHERE a.run <> 'S1' GROUP BY a.run""")
def _(t):
    ret = t.returns()
    base = ret.where("run = 'S1'").select("ts", F.col("ret").alias("base"))
    return ret.where("run <> 'S1'").join(base, "ts").groupBy("run").agg(
        F.count(F.lit(1)).alias("n_common"), r(F.avg(F.col("ret") - F.col("base")), "mean_delta"))


@query("jon_16_common_calendar", """
WITH n AS (SELECT count(DISTINCT series_id) AS k FROM macro),
c AS (SELECT "timestamp" FROM macro GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT k FROM n))
SELECT m.series_id, count(*) AS n_rows, count(CASE WHEN c."timestamp" IS NULL THEN 1 END) AS n_dropped FROM macro m LEFT JOIN c USING ("timestamp") GROUP BY 1""")
def _(t):
    m = t.macro()
    per_day = m.groupBy("timestamp").agg(F.collect_set("series_id").alias("have"))  # one entry per arm
    arms = m.agg(F.countDistinct("series_id").alias("k")).withColumn("_k", F.lit(1))
    common = per_day.withColumn("_k", F.lit(1)).join(arms, "_k").where(F.size("have") == F.col("k")).select(
        "timestamp", F.lit(True).alias("kept"))
    return m.join(common, "timestamp", "left").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("kept").isNull()).alias("n_dropped"))


@query("jon_18_unscored_documents", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return t.raw("documents").select("doc_id", "source").join(t.raw("labels"), "doc_id", "left_anti")


@query("jon_20_symbol_lookup_unmatched", """
SELECT symbol, count(*) AS n_docs, s_suppkey IS NOT NULL AS matched FROM docs LEFT JOIN supplier ON symbol = 'S' || s_suppkey GROUP BY 1, 3""")
def _(t):
    ids = t.raw("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.lit(True).alias("hit"))
    per_symbol = t.docs().groupBy("symbol").agg(F.count(F.lit(1)).alias("n_docs"))
    return per_symbol.join(ids, "symbol", "left").select("symbol", "n_docs", F.coalesce("hit", F.lit(False)).alias("matched"))


@query("set_04_calendar_intersection", """
SELECT ts FROM (SELECT DISTINCT ts FROM bars INTERSECT SELECT DISTINCT "timestamp" FROM macro)""")
def _(t):
    return t.bars().select("ts").intersect(t.macro().select(F.col("timestamp").alias("ts")))


@query("set_05_calendar_difference", """
SELECT d AS ts, side FROM (SELECT ts AS d, 'bars_only' AS side FROM (SELECT DISTINCT ts FROM bars EXCEPT SELECT "timestamp" FROM macro)
UNION ALL SELECT ts, 'macro_only' FROM (SELECT DISTINCT "timestamp" AS ts FROM macro EXCEPT SELECT ts FROM bars))""")
def _(t):
    a, b = t.bars().select("ts").distinct(), t.macro().select(F.col("timestamp").alias("ts")).distinct()
    return a.join(b, "ts", "left_anti").withColumn("side", F.lit("bars_only")).unionByName(
        b.join(a, "ts", "left_anti").withColumn("side", F.lit("macro_only")))


# --- dates ----------------------------------------------------------------------------------
_WK = """wk AS (SELECT CAST(d AS DATE) AS day, row_number() OVER (ORDER BY d) AS i FROM generate_series(DATE '1994-11-01', DATE '2002-03-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5),
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
fwd AS (SELECT days.day, min(i) AS i FROM days JOIN wk ON wk.day >= days.day AND wk.day <= days.day + 3 GROUP BY 1),
bwd AS (SELECT days.day, max(i) AS i FROM days JOIN wk ON wk.day <= days.day AND wk.day >= days.day - 3 GROUP BY 1)"""
LAGS = (0, 1, 2, 5, 7)


@query("dat_02_business_day_shift", f"""WITH {_WK}
SELECT CAST(fwd.day AS VARCHAR) AS day, {', '.join(f'CAST(w{k}.day AS VARCHAR) AS plus_{k}' for k in LAGS)} FROM fwd
{' '.join(f'JOIN wk w{k} ON w{k}.i = fwd.i + {k}' for k in LAGS)}""")
def _(t):
    days = t.raw("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"),
                       *[dt.shift_bdays(F.col("day"), k).cast("string").alias(f"plus_{k}") for k in LAGS])


@query("dat_03_business_day_shift_back", f"""WITH {_WK}
SELECT CAST(bwd.day AS VARCHAR) AS day, {', '.join(f'CAST(w{k}.day AS VARCHAR) AS minus_{k}' for k in LAGS)} FROM bwd
{' '.join(f'JOIN wk w{k} ON w{k}.i = bwd.i - {k}' for k in LAGS)}""")
def _(t):
    days = t.raw("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"),
                       *[dt.shift_bdays_back(F.col("day"), k).cast("string").alias(f"minus_{k}") for k in LAGS])


@query("dat_04_nth_session_before", """
WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM bars)
SELECT CAST(session AS VARCHAR) AS session, CAST(lag(session, 5) OVER (ORDER BY session) AS VARCHAR) AS nth_before FROM s""")
def _(t):
    out = dt.nth_session_before(dt.sessions_of(t.bars()), 5)
    return out.select(F.col("session").cast("string").alias("session"), F.col("nth_before").cast("string").alias("nth_before"))


@query("dat_05_trading_days", """
WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM bars)
SELECT o_orderkey, CAST(d AS VARCHAR) AS day, x.session IS NOT NULL AS is_session, CAST(a.session AS VARCHAR) AS last_session
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) o LEFT JOIN s x ON x.session = d ASOF LEFT JOIN s a ON d >= a.session""")
def _(t):
    refs = t.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    out = dt.last_session_on_or_before(dt.sessions_of(t.bars()), refs, "day")
    return out.select("o_orderkey", F.col("day").cast("string").alias("day"), "is_session",
                      F.col("last_session").cast("string").alias("last_session"))


@query("dat_06_deadlines", """
SELECT CAST(s AS VARCHAR) AS session, s + INTERVAL 1 DAY + INTERVAL 6 HOURS AS due FROM (SELECT DISTINCT CAST(ts AS DATE) AS s FROM bars)""")
def _(t):
    s = dt.sessions_of(t.bars())
    return s.select(F.col("session").cast("string").alias("session"), dt.deadline(F.col("session"), F.lit(1), F.lit(6)).alias("due"))


@query("dat_07_age_days", """
SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-15 03:00:00') - epoch_us(ts)) / 86400000000.0::DOUBLE, 2) AS age FROM events""")
def _(t):
    return t.raw("events").select("event_id", dt.age_days(F.lit("2024-02-15 03:00:00").cast("timestamp"), F.col("ts")).alias("age"))


_RFC = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' GMT' WHEN 1 THEN strftime(o_orderdate, '%a, %d %b %Y') || ' 10:30:00 -0500'
  WHEN 2 THEN strftime(o_orderdate, '%d %b %Y') || ' 06:00:00 EST' WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE '' END"""


@query("dat_01_feed_dates", f"""
SELECT o_orderkey, raw, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 930 MINUTES WHEN 2 THEN o_orderdate + INTERVAL 11 HOURS END AS parsed
FROM (SELECT *, {_RFC} AS raw FROM orders)""")
def _(t):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    weekday = F.element_at(F.array(*[F.lit(x) for x in "Mon Tue Wed Thu Fri Sat Sun".split()]), F.weekday(d) + 1)
    day = F.date_format(d, "dd MMM yyyy")
    raw = (F.when(k == 0, F.concat(weekday, F.lit(", "), F.date_format(d, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
           .when(k == 1, F.concat(weekday, F.lit(", "), day, F.lit(" 10:30:00 -0500")))
           .when(k == 2, F.concat(day, F.lit(" 06:00:00 EST"))).when(k == 3, F.date_format(d, "yyyy/MM/dd")).otherwise(""))
    return t.raw("orders").select("o_orderkey", raw.alias("raw")).withColumn("parsed", dt.rfc2822_to_ts(F.col("raw")))


@query("dat_10_lookback_cutoff", "SELECT symbol, ts, ts - INTERVAL 30 DAYS AS cutoff FROM bars")
def _(t):
    return t.bars().select("symbol", "ts", (F.col("ts") - F.expr("INTERVAL 30 DAYS")).alias("cutoff"))


@query("dat_09_calendar_parts", """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS n_bars, count(DISTINCT symbol) AS n_symbols FROM bars GROUP BY 1, 2""")
def _(t):
    per = t.bars().groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"), "symbol").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("year", "month").agg(F.sum("k").alias("n_bars"), F.count(F.lit(1)).alias("n_symbols"))


@query("win_07_forward_std", f"""
SELECT symbol, ts, {r6("CASE WHEN count(ret_1d) OVER f = 10 THEN stddev_samp(ret_1d) OVER f END", 'fwd_std')} FROM px_ret
WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""")
def _(t):
    b = t.bars().withColumn("ret", win.pct_change("close", 1))
    return b.select("symbol", "ts", r(win.forward_std("ret", 10), "fwd_std"))


@query("win_10_forward_fill", f"""
SELECT symbol, ts, {r6('last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts)','filled')} FROM (
  SELECT symbol, ts, CASE WHEN "close" > open THEN "close" END AS x FROM bars)""")
def _(t):
    b = t.bars().withColumn("x", F.when(F.col("close") > F.col("open"), F.col("close")))
    return b.select("symbol", "ts", r(win.ffill("x"), "filled"))


@query("win_12_competition_rank", """
SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST) AS BIGINT) AS rnk FROM supplier""")
def _(t):
    return competition_rank(t.raw("supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", F.col("rank").alias("rnk"))
