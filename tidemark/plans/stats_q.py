"""Forecast comparison, resampling and deflation queries."""
import math

from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import labels as lab
from tidemark.operators import metrics as met
from tidemark.operators import ranks
from tidemark.operators import regimes as reg
from tidemark.operators import stats as st
from tidemark.operators import windows as win
from tidemark.plans.oracle_ctes import norm_cdf_sql, t_cdf_sql, uniform_sql
from tidemark.plans.registry import query, r6
from tidemark.sources.lake import materialized

ERAS = (("qe_bull", "1996-07-01", "1998-06-30"), ("covid", "1998-07-01", "1999-12-31"),
        ("rate_cycle", "2000-01-01", "2099-12-31"))
SCHEMES = ["long", "mom", "rev"]


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


def scheme_predictions(t):
    """Three forecasts of every bar's next return. Returns are written once a query, however many branches read them."""
    def build():
        b = t.bars().withColumns({"ret": win.pct_change("close", 1), "y": lab.forward_return(1)})
        return b.where("ret IS NOT NULL AND y IS NOT NULL").select("symbol", "ts", "ret", "y")

    return t.once("scheme_returns", build).select("symbol", "ts", F.col("y").alias("y_true"), F.expr(
        "stack(3, 'long', 0.001D, 'mom', ret, 'rev', -0.5D * ret) AS (scheme, y_pred)"))


def scheme_daily(t):
    def build():
        daily = scheme_predictions(t).groupBy("scheme", "ts").agg(F.avg(F.col("y_true") - F.col("y_pred")).alias("err"),
                                                                  F.avg(F.signum("y_pred") * F.col("y_true")).alias("ret"))
        return reg.tag(daily, reg.era_detector(ERAS))

    return t.once("scheme_daily", build)


def paired(t, value="ret", variant="rev", baseline="long"):
    """(ts, regime, variant, baseline): two schemes side by side, one scan of the daily table."""
    d = scheme_daily(t)
    return d.groupBy("ts", "regime").agg(F.max(F.when(F.col("scheme") == variant, F.col(value))).alias("variant"),
                                         F.max(F.when(F.col("scheme") == baseline, F.col(value))).alias("baseline"))


@query("rep_05_forecast_errors", f"SELECT scheme, ts, {r6('err','err')}, {r6('ret','ret')}, regime FROM scheme_daily")
def _(t):
    return scheme_daily(t).select("scheme", "ts", r("err", "err"), r("ret", "ret"), "regime")


@query("met_11_mae_rmse", f"SELECT scheme, {r6('avg(abs(y_true - y_pred))','mae')}, {r6('sqrt(avg(pow(y_true - y_pred, 2)))','rmse')}, count(*) AS n FROM scheme_pred GROUP BY 1")
def _(t):
    return met.forecast_errors(scheme_predictions(t), ["scheme"]).select("scheme", r("mae", "mae"), r("rmse", "rmse"), "n")


@query("met_18_hit_rate_and_correlation", f"""
SELECT scheme, {r6('avg(CAST(sign(y_true) = sign(y_pred) AS DOUBLE))','hit_rate')}, {r6("CASE WHEN scheme <> 'long' THEN corr(y_true, y_pred) END",'corr')} FROM scheme_pred GROUP BY 1""")
def _(t):
    out = scheme_predictions(t).groupBy("scheme").agg(F.avg((F.signum("y_true") == F.signum("y_pred")).cast("double")).alias("h"), special.correlation(F.col("y_true"), F.col("y_pred")).alias("c"))
    return out.select("scheme", r("h", "hit_rate"), r(F.when(F.col("scheme") != "long", F.col("c")), "corr"))


_AUC = """(sum(CASE WHEN y_true > 0 THEN rk END) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0)"""


@query("met_10_roc_auc_by_regime", f"""
WITH p AS (SELECT p.*, coalesce(e.name, 'pre_qe') AS regime FROM scheme_pred p LEFT JOIN eras e ON CAST(p.ts AS DATE) BETWEEN e.lo AND e.hi WHERE scheme <> 'long'),
k AS (SELECT *, rank() OVER (PARTITION BY scheme, regime ORDER BY y_pred) + (count(*) OVER (PARTITION BY scheme, regime, y_pred) - 1) / 2.0 AS rk,
  count(CASE WHEN y_true > 0 THEN 1 END) OVER (PARTITION BY scheme, regime) AS n1, count(CASE WHEN y_true <= 0 THEN 1 END) OVER (PARTITION BY scheme, regime) AS n0 FROM p)
SELECT scheme, regime, {r6('auc','auc')}, n FROM (SELECT scheme, regime, {_AUC} AS auc, n1 + n0 AS n FROM k GROUP BY scheme, regime, n1, n0)""")
def _(t):
    p = reg.tag(scheme_predictions(t).where("scheme <> 'long'"), reg.era_detector(ERAS))
    return ranks.roc_auc(p, ["scheme", "regime"]).select("scheme", "regime", r("auc", "auc"), "n")


@query("met_10_roc_auc_labels", f"""
WITH p AS (SELECT d.doc_id, CAST(quality AS DOUBLE) AS y_true, n_chars AS y_pred, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM documents d JOIN labels l USING (doc_id)),
n AS (SELECT count(CASE WHEN y_true > 0 THEN 1 END) AS n1, count(CASE WHEN y_true <= 0 THEN 1 END) AS n0 FROM p)
SELECT 'quality' AS target, {r6(f'{_AUC}','auc')}, n1 + n0 AS n FROM p, n GROUP BY n1, n0""")
def _(t):
    p = t.raw("documents").join(t.raw("labels"), "doc_id").select(F.lit("quality").alias("target"), F.col("quality").alias("y_true"), F.col("n_chars").alias("y_pred"))
    return ranks.roc_auc(p, ["target"]).select("target", r("auc", "auc"), "n")


@query("met_12_brier_improvement", f"""
WITH p AS (SELECT symbol, ts, CAST(y_true > 0 AS DOUBLE) AS y, 1 / (1 + exp(-20 * y_pred)) AS p FROM scheme_pred WHERE scheme = 'rev')
SELECT symbol, {r6('avg(pow(b - y, 2) - pow(p - y, 2))','brier_improvement')}, count(*) AS n FROM (SELECT *, avg(y) OVER (PARTITION BY symbol) AS b FROM p) GROUP BY 1""")
def _(t):
    from pyspark.sql import Window

    p = scheme_predictions(t).where("scheme = 'rev'").select("symbol", "ts", (F.col("y_true") > 0).cast("double").alias("y"),
                                                            (1 / (1 + F.exp(-20 * F.col("y_pred")))).alias("p"))
    p = p.withColumn("b", F.avg("y").over(Window.partitionBy("symbol")))
    return p.groupBy("symbol").agg(r(F.avg(F.pow(F.col("b") - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2)), "brier_improvement"), F.count(F.lit(1)).alias("n"))


def dm_sql(src: str, keys: str, h: int = 1) -> str:
    lags = ", ".join(f"avg(e * l{j}) AS g{j}" for j in range(1, h))
    lcols = ", ".join(f"lag(e, {j}) OVER (PARTITION BY {keys} ORDER BY ts) AS l{j}" for j in range(1, h))
    spread = "g0" + "".join(f" + 2 * (1 - {j} / {h}.0) * g{j}" for j in range(1, h))
    return f"""
SELECT {keys}, n_obs, m / sqrt(({spread}) / n_obs) * sqrt((n_obs + 1 - 2 * {h} + {h} * ({h} - 1) / n_obs::DOUBLE) / n_obs) AS statistic FROM (
  SELECT {keys}, count(*) AS n_obs, max(m) AS m, avg(e * e) AS g0{', ' + lags if lags else ''} FROM (
    SELECT *{', ' + lcols if lcols else ''} FROM (SELECT *, d - m AS e FROM (
      SELECT *, avg(d) OVER (PARTITION BY {keys}) AS m FROM (SELECT *, err_a * err_a - err_b * err_b AS d FROM {src})))) GROUP BY {keys})"""


_PAIR = """pr AS (SELECT a.scheme AS scheme_a, b.scheme AS scheme_b, a.ts, a.regime, a.err AS err_a, b.err AS err_b FROM scheme_daily a JOIN scheme_daily b ON a.ts = b.ts AND a.scheme < b.scheme)"""


@query("sta_01_diebold_mariano", f"""
WITH {_PAIR}, s AS ({dm_sql('pr', 'scheme_a, scheme_b', 5)})
SELECT scheme_a, scheme_b, n_obs, {r6('statistic','statistic')}, {r6(t_cdf_sql('statistic', '(n_obs - 1)'),'p_value')} FROM s""")
def _(t):
    out = st.dm_matrix(scheme_daily(t), "scheme", SCHEMES, h=5)
    return out.select("scheme_a", "scheme_b", "n_obs", r("statistic", "statistic"), r("p_value", "p_value"))


@query("sta_03_regime_dm_matrix", f"""
WITH {_PAIR}, s AS ({dm_sql('pr', 'scheme_a, scheme_b, regime')})
SELECT scheme_a, scheme_b, regime, n_obs, {r6('statistic','statistic')}, {r6(t_cdf_sql('statistic', '(n_obs - 1)'),'p_value')} FROM s""")
def _(t):
    out = st.dm_matrix(scheme_daily(t), "scheme", SCHEMES, by=["regime"])
    return out.select("scheme_a", "scheme_b", "regime", "n_obs", r("statistic", "statistic"), r("p_value", "p_value"))


def positions_sql(src: str, keys: str, n_boot: int, seed: int, block: int = 21, kind: str = "stationary") -> str:
    """CTEs pl (rows with place i and count n) and po (replicate, i, pos): drawn blocks, laid out place by place."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    number = "(CAST('0x' || substr(h, {}, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"
    moving = kind == "moving"
    many = f"CAST(ceil(n / {block}.0::DOUBLE" + ("" if moving else f" + 12 * sqrt(n / {block}.0::DOUBLE) + 12") + ") AS BIGINT)"
    length = str(block) if moving else f"1 + CAST(floor(ln(1 - {number.format(13)}) / ln(1 - 1.0::DOUBLE / {block})) AS BIGINT)"
    starts = f"greatest(n - {block}, 1)" if moving else "n"
    return f"""
pl AS (SELECT *, row_number() OVER ({part} ORDER BY ts) - 1 AS i, count(*) OVER ({part}) AS n FROM {src}),
gn AS (SELECT {k}max(n) AS n, {many.replace('(n /', '(max(n) /')} AS m FROM pl{f" GROUP BY {keys}" if keys else ""}),
hb AS (SELECT {k}n, m, rep, b, md5('{seed}|' || rep || '|' || b) AS h FROM (SELECT *, unnest(range(m)) AS b FROM gn), generate_series(1, {n_boot}) t(rep)),
bl AS (SELECT {k}n, rep, b, CAST(floor({number.format(1)} * {starts}) AS BIGINT) AS start, CASE WHEN b = m - 1 THEN n ELSE {length} END AS len FROM hb),
bp AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY {k}rep ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM bl),
po AS (SELECT {k}rep AS replicate, CAST(at0 + s AS BIGINT) AS i, (start + s) % n AS pos FROM (
  SELECT *, unnest(range(CAST(least(len, n - at0) AS BIGINT))) AS s FROM bp WHERE at0 < n))"""


_PV = """pv AS (SELECT a.ts, a.regime, a.ret AS variant, b.ret AS baseline FROM scheme_daily a JOIN scheme_daily b ON a.ts = b.ts AND a.scheme = 'rev' AND b.scheme = 'long')"""


@query("sta_04_block_positions", f"""
WITH {_PV}, {positions_sql('pv', '', 20, 7)}
SELECT CAST(replicate AS INTEGER) AS replicate, i, pos FROM po""")
def _(t):
    return st.block_positions(paired(t), [], 20, seed=7).select("replicate", F.col("i").cast("bigint").alias("i"), "pos")


def _sharpe(c):
    return f"CASE WHEN stddev_samp({c}) > 0 THEN avg({c}) / stddev_samp({c}) * sqrt(252) ELSE 0 END"


@query("sta_05_bootstrap_sharpe_delta", f"""
WITH {_PV}, {positions_sql('pv', 'regime', 1000, 0)},
d AS (SELECT regime, replicate, {_sharpe('variant')} - {_sharpe('baseline')} AS delta FROM po JOIN (SELECT regime, i AS pos, variant, baseline FROM pl) USING (regime, pos) GROUP BY 1, 2)
SELECT regime, {r6('quantile_cont(delta, 0.05)','ci_low')}, {r6('quantile_cont(delta, 0.95)','ci_high')}, count(*) AS n_replicates,
  quantile_cont(delta, 0.05) > 0 OR quantile_cont(delta, 0.95) < 0 AS excludes_zero FROM d GROUP BY 1""")
def _(t):
    out = st.bootstrap_delta_ci(paired(t), ["regime"])
    return out.select("regime", r("ci_low", "ci_low"), r("ci_high", "ci_high"), "n_replicates", "excludes_zero")


@query("sta_06_bootstrap_metric_delta", f"""
WITH pv AS (SELECT a.ts, a.regime, a.err AS variant, b.err AS baseline FROM scheme_daily a JOIN scheme_daily b ON a.ts = b.ts AND a.scheme = 'rev' AND b.scheme = 'long'), {positions_sql('pv', 'regime', 1000, 3)},
d AS (SELECT regime, replicate, avg(abs(variant)) - avg(abs(baseline)) AS delta FROM po JOIN (SELECT regime, i AS pos, variant, baseline FROM pl) USING (regime, pos) GROUP BY 1, 2)
SELECT regime, {r6('quantile_cont(delta, 0.05)','ci_low')}, {r6('quantile_cont(delta, 0.95)','ci_high')}, count(*) AS n_replicates FROM d GROUP BY 1""")
def _(t):
    out = st.bootstrap_delta_ci(paired(t, "err"), ["regime"], metric=st.MEAN_ABSOLUTE, seed=3)
    return out.select("regime", r("ci_low", "ci_low"), r("ci_high", "ci_high"), "n_replicates")


@query("sta_07_moving_block_sharpe", f"""
WITH x AS (SELECT ts, ret FROM scheme_daily WHERE scheme = 'rev'), {positions_sql('x', '', 2000, 42, kind='moving')},
s AS (SELECT replicate, avg(ret) / stddev_pop(ret) * sqrt(252) AS s FROM po JOIN (SELECT i AS pos, ret FROM pl) USING (pos) GROUP BY 1)
SELECT 'rev' AS scheme, {r6('quantile_cont(s, 0.025)','ci_low')}, {r6('quantile_cont(s, 0.975)','ci_high')} FROM s""")
def _(t):
    out = st.moving_block_sharpe_ci(scheme_daily(t).where("scheme = 'rev'"), ["scheme"])
    return out.select("scheme", r("ci_low", "ci_low"), r("ci_high", "ci_high"))


# Inverse normal by bisection over the Simpson CDF.
PPF = f"""ppf AS (SELECT id, p, -8.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, 0 AS it FROM ps
  UNION ALL SELECT id, p, CASE WHEN {norm_cdf_sql('(lo + hi) / 2')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {norm_cdf_sql('(lo + hi) / 2')} < p THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM ppf WHERE it < 50)"""
MAX_SHARPE = f"""ps AS (SELECT n * 2 AS id, 1 - 1.0 / n AS p FROM ns UNION ALL SELECT n * 2 + 1, 1 - 1 / (n * exp(1.0)) FROM ns), {PPF},
zs AS (SELECT id // 2 AS n, max(CASE WHEN id % 2 = 0 THEN (lo + hi) / 2 END) AS z1, max(CASE WHEN id % 2 = 1 THEN (lo + hi) / 2 END) AS z2 FROM ppf WHERE it = 50 GROUP BY 1),
ms AS (SELECT n, (1 - 0.5772156649015329) * z1 + 0.5772156649015329 * z2 AS unit_max FROM zs)"""


@query("sta_08_expected_max_sharpe", f"""
WITH RECURSIVE tr AS (SELECT o_orderpriority AS agent, count(DISTINCT o_custkey) % 90 + 10 AS n, stddev_samp(o_totalprice) / 100000 AS sd FROM orders GROUP BY 1),
ns AS (SELECT DISTINCT n FROM tr), {MAX_SHARPE}
SELECT agent, CAST(n AS BIGINT) AS n_trials, {r6('sd * unit_max','expected_max')} FROM tr JOIN ms USING (n)""")
def _(t):
    o = t.raw("orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("o_totalprice").alias("k"), F.sum("o_totalprice").alias("s"), F.sum(F.pow("o_totalprice", 2)).alias("q"))
    n, s, q = F.sum("k"), F.sum("s"), F.sum("q")
    tr = o.groupBy(F.col("o_orderpriority").alias("agent")).agg((F.count(F.lit(1)) % 90 + 10).alias("n_trials"), F.sqrt((q - s * s / n) / (n - 1)).alias("sd"))
    return tr.select("agent", "n_trials", r(special.expected_max_sharpe(F.col("n_trials"), F.col("sd") / 100000), "expected_max"))


@query("sta_09_deflated_sharpe", f"""
WITH RECURSIVE ns AS (SELECT 74 AS n FROM bars LIMIT 1), {MAX_SHARPE},
m AS (SELECT run, count(*) AS n_obs, {_sharpe('ret')} AS sr, skewness(ret) AS sk, kurtosis(ret) AS ku FROM rets GROUP BY 1),
z AS (SELECT m.*, (sr - 0.35 * unit_max) / sqrt(252) * sqrt(n_obs - 1) / sqrt(greatest(1 - sk * sr / sqrt(252) + (ku + 2) / 4 * sr * sr / 252, 1e-12)) AS z, 0.35 * unit_max AS bench FROM m, ms)
SELECT run, n_obs, {r6('sr','sr_observed')}, {r6('sk','skew')}, {r6('ku','excess_kurtosis')}, {r6('bench','sr_benchmark')}, {r6('z','z')}, {r6(norm_cdf_sql('z'),'dsr')}, z > 0 AS passed FROM z""")
def _(t):
    out = st.deflated_sharpe(t.returns(), ["run"], 74)
    return out.select("run", "n_obs", *[r(c, c) for c in ("sr_observed", "skew", "excess_kurtosis", "sr_benchmark", "z", "dsr")], "passed")


@query("sta_10_mertens_deflation", f"""
WITH RECURSIVE ns AS (SELECT 50 AS n FROM bars LIMIT 1), {MAX_SHARPE},
m AS (SELECT run, count(*)::DOUBLE AS n, {_sharpe('ret')} / sqrt(252) AS sr, avg(ret) AS mu FROM rets GROUP BY 1),
c AS (SELECT run, avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4 FROM rets JOIN m USING (run) GROUP BY 1),
s AS (SELECT run, sr, sqrt((1 + 0.5 * sr * sr - m3 / pow(m2, 1.5) * sr + (m4 / (m2 * m2) - 3) / 4 * sr * sr) / n) AS se FROM m JOIN c USING (run))
SELECT run, {r6('se','se')}, {r6('se * unit_max','benchmark')}, {r6(norm_cdf_sql('((sr - se * unit_max) / se)'),'dsr')} FROM s, ms""")
def _(t):
    out = st.mertens_deflation(t.returns(), ["run"], 50)
    return out.select("run", r("se", "se"), r("benchmark", "benchmark"), r("dsr", "dsr"))


@query("sta_11_skill_z", f"""
WITH s AS (SELECT v.symbol, abs(b.y_true - b.y_pred) - abs(v.y_true - v.y_pred) AS skill FROM scheme_pred v JOIN scheme_pred b ON v.symbol = b.symbol AND v.ts = b.ts AND v.scheme = 'rev' AND b.scheme = 'long')
SELECT symbol, count(*) AS n_obs, {r6('avg(skill)','mean_skill')}, {r6('stddev_samp(skill) / sqrt(count(*))','se_skill')}, {r6('avg(skill) / (stddev_samp(skill) / sqrt(count(*)))','z')}, avg(skill) > 0 AS passed FROM s GROUP BY 1""")
def _(t):
    err = F.abs(F.col("y_true") - F.col("y_pred"))
    wide = scheme_predictions(t).groupBy("symbol", "ts").agg((F.max(F.when(F.col("scheme") == "long", err)) - F.max(F.when(F.col("scheme") == "rev", err))).alias("skill"))
    out = st.skill_z(wide, ["symbol"])
    return out.select("symbol", "n_obs", r("mean_skill", "mean_skill"), r("se_skill", "se_skill"), r("z", "z"), "passed")


@query("sta_12_spearman", f"""
WITH p AS (SELECT symbol, y_true, y_pred, rank() OVER (PARTITION BY symbol ORDER BY y_true) + (count(*) OVER (PARTITION BY symbol, y_true) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY symbol ORDER BY y_pred) + (count(*) OVER (PARTITION BY symbol, y_pred) - 1) / 2.0 AS rb FROM scheme_pred WHERE scheme = 'rev')
SELECT symbol, {r6('CASE WHEN count(*) >= 3 AND count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN corr(ra, rb) END','rho')}, count(*) AS n FROM p GROUP BY 1""")
def _(t):
    out = ranks.spearman(scheme_predictions(t).where("scheme = 'rev'"), ["symbol"], "y_true", "y_pred")
    return out.select("symbol", r("rho", "rho"), "n")


FEATS = ["ret_1d", "ret_5d", "ret_21d", "vol_21d", "vol_63d", "rsi_14", "ma50_ratio", "ma200_ratio", "volume_ratio"]
def abs_corr_sql(name: str, where: str) -> str:
    """(feature, <name>): absolute correlation with the next return over part of history."""
    return f"(SELECT {', '.join(f'abs(corr({c}, y)) AS {c}' for c in FEATS)} FROM w WHERE {where}) UNPIVOT ({name} FOR feature IN ({', '.join(FEATS)}))"


_VIEWS = f"""
w AS (SELECT f.*, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat f),
v AS (SELECT feature, a, b FROM {abs_corr_sql('a', "ts < TIMESTAMP '1999-01-01'")} JOIN (SELECT feature, b FROM {abs_corr_sql('b', "ts >= TIMESTAMP '1999-01-01'")}) USING (feature)),
k AS (SELECT feature, rank() OVER (ORDER BY a)::DOUBLE AS ra, rank() OVER (ORDER BY b)::DOUBLE AS rb, row_number() OVER (ORDER BY feature) AS k FROM v)"""


def importance_views(t, split="1999-01-01", again=None):
    """(feature, a, b): absolute correlation with the next return before and from a date.

    With ``again``, an earlier date, also ``c``: that of the history before it. One pass takes the moments
    of every feature and stretch of time; a view joins those of its stretches.
    """
    from tidemark.operators.features import price_features

    f = price_features(t.bars().withColumn("y", lab.forward_return(1)))
    pairs = ", ".join(f"'{c}', {c}" for c in FEATS)
    stretch = F.when(F.col("ts") < (again or split), 0).when(F.col("ts") < split, 1).otherwise(2)
    tall = f.select(stretch.alias("stretch"), "y", F.expr(f"stack({len(FEATS)}, {pairs}) AS (feature, x)")).where("x IS NOT NULL AND y IS NOT NULL")
    parts = tall.groupBy("feature", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
        F.covar_pop("x", "y").alias("cxy"))
    views = {"a": F.col("stretch") < 2, "b": F.col("stretch") == 2} | ({"c": F.col("stretch") == 0} if again else {})
    return parts.groupBy("feature").agg(*[F.abs(special.joined_correlation(keep)).alias(k) for k, keep in views.items()])


PERMUTED = f"""{_VIEWS}, o AS (SELECT corr(ra, rb) AS rho, count(*) AS n FROM k),
g AS (SELECT rep, ra, row_number() OVER (PARTITION BY rep ORDER BY {uniform_sql("'5'", 'rep', 'feature')}, feature) AS k FROM k, generate_series(1, 10000) t(rep)),
c AS (SELECT rep, corr(g.ra, k.rb) AS rho FROM g JOIN k USING (k) GROUP BY 1),
pm AS (SELECT max(o.rho) AS rho, max(o.n) AS n, (1 + count(CASE WHEN c.rho >= o.rho - 1e-12 THEN 1 END)) / 10001.0 AS p_value FROM c, o)"""


@query("sta_13_permutation_p", f"WITH {PERMUTED} SELECT {r6('rho','rho')}, n, {r6('p_value','p_value')} FROM pm")
def _(t):
    out = st.rank_agreement(importance_views(t), [], "a", "b", seed=5)
    return out.select(r("rho", "rho"), "n", r("p_value", "p_value"))


@query("sta_14_view_rank_correlation", f"WITH {_VIEWS} SELECT {r6('corr(ra, rb)','rho')}, count(*) AS n FROM k")
def _(t):
    v = importance_views(t).withColumn("_all", F.lit(1))
    return ranks.spearman(v, ["_all"], "a", "b").select(r("rho", "rho"), "n")


_CUM = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
_PW = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in _CUM)


@query("sta_15_coefficient_bootstrap", f"""
WITH p AS (SELECT symbol, ts, y_true AS y, y_pred AS x FROM scheme_pred WHERE scheme = 'mom'),
g AS (SELECT rep, x, y, {_PW} AS w FROM (SELECT rep, x, y, {uniform_sql("'9'", 'rep', 'symbol', 'CAST(epoch(ts) AS BIGINT)')} AS u FROM p, generate_series(1, 50) t(rep))),
c AS (SELECT rep, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) AS b FROM g GROUP BY 1)
SELECT 'y_pred' AS feature, {r6('quantile_cont(b, 0.05)','ci_low')}, {r6('quantile_cont(b, 0.95)','ci_high')} FROM c""")
def _(t):
    from tidemark.operators.models import gram, solve

    p = scheme_predictions(t).where("scheme = 'mom'").select("y_true", "y_pred", F.concat_ws("|", "symbol", F.unix_seconds("ts").cast("string")).alias("_row"))
    p = p.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(50))))
    weight = st.poisson_draw(F.lit(9), F.col("replicate"), F.col("_row"))
    fits = solve(gram(p, ["replicate"], ["y_pred"], "y_true", weight), ["replicate"], ["y_pred"])
    return fits.agg(F.lit("y_pred").alias("feature"), r(F.percentile(F.col("beta")[1], 0.05), "ci_low"), r(F.percentile(F.col("beta")[1], 0.95), "ci_high"))


@query("mth_03_normal_cdf", f"""
SELECT symbol, {r6(norm_cdf_sql('x'),'cdf')}, {r6(t_cdf_sql('x', 'n'),'t_cdf')} FROM (SELECT symbol, avg(ret_1d) / stddev_samp(ret_1d) * sqrt(count(ret_1d)) AS x, count(ret_1d)::DOUBLE AS n FROM px_ret GROUP BY 1)""")
def _(t):
    b = t.bars().withColumn("ret", win.pct_change("close", 1)).groupBy("symbol").agg(
        (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.count("ret"))).alias("x"), F.count("ret").cast("double").alias("n"))
    return b.select("symbol", r(special.norm_cdf(F.col("x")), "cdf"), r(special.t_cdf(F.col("x"), F.col("n")), "t_cdf"))


@query("mth_07_drawdown_probability", f"""
SELECT symbol, {r6("greatest(0, least(1, 2 * " + norm_cdf_sql('(-0.05 / (v * sqrt(21)))') + "))",'p_drawdown')} FROM (SELECT symbol, stddev_samp(ret_1d) AS v FROM px_ret GROUP BY 1)""")
def _(t):
    b = t.bars().withColumn("ret", win.pct_change("close", 1)).groupBy("symbol").agg(F.ln(F.stddev_samp("ret")).alias("lv"))
    return b.select("symbol", r(special.drawdown_probability(F.col("lv"), 0.05, 21), "p_drawdown"))
