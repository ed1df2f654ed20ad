"""Gate queries on scheme metrics."""
from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.operators import gates as gat
from tidemark.operators import metrics as met
from tidemark.operators import ranks
from tidemark.operators import regimes as reg
from tidemark.operators import reports as rpt
from tidemark.operators import stats as st
from tidemark.operators import windows as win
from tidemark.plans.oracle_ctes import norm_cdf_sql, t_cdf_sql
from tidemark.plans.registry import query, r6
from tidemark.plans.stats_q import (_PV, ERAS, FEATS, MAX_SHARPE, PERMUTED, abs_corr_sql, dm_sql, importance_views, paired, positions_sql,
                                    scheme_daily, scheme_predictions)
from tidemark.sources.lake import materialized

REGIMES = ["pre_qe", "qe_bull", "covid", "rate_cycle"]


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


def scheme_metrics(t):
    d = scheme_daily(t).withColumnRenamed("scheme", "run")
    both = d.withColumn("regime", F.explode(F.array("regime", F.lit("aggregate"))))
    return both.groupBy("run", "regime").agg(met.sharpe("ret").alias("sharpe"), F.count("ret").alias("n_bars"))


_SM = """sm AS (SELECT scheme AS run, regime, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sharpe, count(*) AS n_bars
 FROM (SELECT scheme, ret, regime FROM scheme_daily UNION ALL SELECT scheme, ret, 'aggregate' FROM scheme_daily) GROUP BY 1, 2)"""
_DM = f"""er AS (SELECT a.ts, a.regime, a.err AS err_a, b.err AS err_b FROM scheme_daily a JOIN scheme_daily b ON a.ts = b.ts AND a.scheme = 'rev' AND b.scheme = 'mom'),
dm AS (SELECT regime, {t_cdf_sql('statistic', '(n_obs - 1)')} AS p_value FROM ({dm_sql('er', 'regime')}))"""
_GATE = f"""g AS (SELECT count(CASE WHEN v.sharpe > b.sharpe THEN 1 END) AS pass_count, count(CASE WHEN dm.p_value < ALPHA THEN 1 END) AS significant_count
 FROM sm v JOIN sm b ON v.regime = b.regime AND v.run = 'rev' AND b.run = 'mom' JOIN dm ON dm.regime = v.regime WHERE v.regime IN ('qe_bull', 'covid', 'rate_cycle'))"""


def dm_rev_mom(t):
    d = scheme_daily(t)
    wide = d.groupBy("ts", "regime").agg(F.max(F.when(F.col("scheme") == "rev", F.col("err"))).alias("err_a"), F.max(F.when(F.col("scheme") == "mom", F.col("err"))).alias("err_b"))
    return st.regime_dm(wide, [])


@query("sta_02_regime_dm", f"WITH {_DM} SELECT regime, {r6('p_value','p_value')} FROM dm")
def _(t):
    return dm_rev_mom(t).select("regime", r("p_value", "p_value"))


@query("gat_01_regime_gate", f"WITH {_SM}, {_DM}, {_GATE.replace('ALPHA', '0.05')} SELECT *, pass_count >= 2 AND significant_count >= 1 AS gate_passed FROM g")
def _(t):
    comp = gat.regime_comparison(scheme_metrics(t), "rev", "mom")
    return gat.regime_gate(comp, dm_rev_mom(t))


@query("gat_01_regime_detail", f"""WITH {_SM}
SELECT v.regime, {r6('v.sharpe','variant_sharpe')}, {r6('b.sharpe','baseline_sharpe')}, v.sharpe > b.sharpe AS beats FROM sm v JOIN sm b ON v.regime = b.regime AND v.run = 'rev' AND b.run = 'mom'""")
def _(t):
    out = gat.regime_comparison(scheme_metrics(t), "rev", "mom")
    return out.select("regime", r("variant_sharpe", "variant_sharpe"), r("baseline_sharpe", "baseline_sharpe"), "beats")


@query("gat_13_bonferroni_gate", f"WITH {_SM}, {_DM}, {_GATE.replace('ALPHA', '0.05 / 3')} SELECT *, pass_count >= 2 AND significant_count >= 1 AS gate_passed FROM g")
def _(t):
    return gat.regime_gate(gat.regime_comparison(scheme_metrics(t), "rev", "mom"), dm_rev_mom(t), alpha=gat.BONFERRONI_ALPHA)


@query("gat_02_deflation_gate", f"""
WITH RECURSIVE {_SM}, {_DM}, {_GATE.replace('ALPHA', '0.05')}, ns AS (SELECT DISTINCT 74 AS n FROM region), {MAX_SHARPE},
m AS (SELECT count(*) AS n_obs, avg(ret) / stddev_samp(ret) * sqrt(252) AS sr, skewness(ret) AS sk, kurtosis(ret) AS ku FROM scheme_daily WHERE scheme = 'rev'),
z AS (SELECT (sr - 0.35 * unit_max) / sqrt(252) * sqrt(n_obs - 1) / sqrt(greatest(1 - sk * sr / sqrt(252) + (ku + 2) / 4 * sr * sr / 252, 1e-12)) AS z FROM m, ms)
SELECT pass_count, significant_count, {r6(norm_cdf_sql('z'),'dsr')}, z > 0 AS dsr_passed, pass_count >= 2 AND significant_count >= 1 AND z > 0 AS gate_passed FROM g, z""")
def _(t):
    gate = gat.regime_gate(gat.regime_comparison(scheme_metrics(t), "rev", "mom"), dm_rev_mom(t))
    dsr = st.deflated_sharpe(scheme_daily(t).where("scheme = 'rev'"), ["scheme"], 74)
    return gat.with_deflation(gate, dsr).select("pass_count", "significant_count", r("dsr", "dsr"), "dsr_passed", "gate_passed")


# --- target gate: AUC and Sharpe of two targets against 'long' -------------------------------
_AUCS = """ap AS (SELECT p.scheme, coalesce(e.name, 'pre_qe') AS regime, y_true, y_pred FROM scheme_pred p LEFT JOIN eras e ON CAST(p.ts AS DATE) BETWEEN e.lo AND e.hi),
ak AS (SELECT *, rank() OVER (PARTITION BY scheme, regime ORDER BY y_pred) + (count(*) OVER (PARTITION BY scheme, regime, y_pred) - 1) / 2.0 AS rk,
  count(CASE WHEN y_true > 0 THEN 1 END) OVER (PARTITION BY scheme, regime) AS n1, count(CASE WHEN y_true <= 0 THEN 1 END) OVER (PARTITION BY scheme, regime) AS n0 FROM ap),
au AS (SELECT scheme, regime, (sum(CASE WHEN y_true > 0 THEN rk END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc FROM ak GROUP BY scheme, regime, n1, n0)"""
_CRIT = f"""{_SM}, {_AUCS}, cr AS (
SELECT v.scheme AS target, v.regime, 'auc' AS metric, 0.02 AS threshold, v.auc - b.auc AS value FROM au v JOIN au b ON b.scheme = 'long' AND b.regime = v.regime WHERE v.scheme <> 'long'
UNION ALL SELECT v.run, v.regime, 'sharpe', 0.10, v.sharpe - b.sharpe FROM sm v JOIN sm b ON b.run = 'long' AND b.regime = v.regime WHERE v.run <> 'long' AND v.regime <> 'aggregate')"""


def criteria(t):
    p = reg.tag(scheme_predictions(t), reg.era_detector(ERAS))
    auc = ranks.roc_auc(p, ["scheme", "regime"]).select(F.col("scheme").alias("run"), "regime", F.lit("auc").alias("metric"), F.lit(0.02).alias("threshold"), F.col("auc").alias("v"))
    sh = scheme_metrics(t).where("regime <> 'aggregate'").select("run", "regime", F.lit("sharpe").alias("metric"), F.lit(0.10).alias("threshold"), F.col("sharpe").alias("v"))
    tall = auc.unionByName(sh)
    base = tall.where("run = 'long'").select("regime", "metric", F.col("v").alias("baseline"))
    return tall.where("run <> 'long'").join(base, ["regime", "metric"]).select(
        F.col("run").alias("target"), "regime", "metric", F.lit("delta_higher").alias("kind"), "threshold", F.col("v").alias("variant"), "baseline")


@query("gat_04_materiality", f"WITH {_CRIT} SELECT target, regime, metric, threshold::DOUBLE AS threshold, {r6('value','value')}, value >= threshold AS met FROM cr")
def _(t):
    return gat.judged(criteria(t)).select("target", "regime", "metric", "threshold", r("value", "value"), "met")


@query("gat_04_relative_reduction", f"""
WITH e AS (SELECT p.scheme, coalesce(e.name, 'pre_qe') AS regime, avg(abs(y_true - y_pred)) AS mae FROM scheme_pred p LEFT JOIN eras e ON CAST(p.ts AS DATE) BETWEEN e.lo AND e.hi GROUP BY 1, 2)
SELECT v.scheme AS target, v.regime, {r6('(b.mae - v.mae) / b.mae','value')}, (b.mae - v.mae) / b.mae >= 0.05 AS met FROM e v JOIN e b ON b.scheme = 'mom' AND b.regime = v.regime WHERE v.scheme <> 'mom'""")
def _(t):
    """How much of the momentum forecast's absolute error each other scheme saves."""
    p = reg.tag(scheme_predictions(t), reg.era_detector(ERAS))
    mae = met.forecast_errors(p, ["scheme", "regime"]).select(F.col("scheme").alias("target"), "regime", F.col("mae").alias("variant"))
    base = mae.where("target = 'mom'").select("regime", F.col("variant").alias("baseline"))
    rows = mae.where("target <> 'mom'").join(base, "regime").withColumns({"metric": F.lit("mae"), "kind": F.lit("rel_reduction"), "threshold": F.lit(0.05)})
    return gat.judged(rows).select("target", "regime", r("value", "value"), "met")


_AGREE = ("ret_5d", "ret_21d", "mom_21d", "ret_126d")


@query("win_13_descending_average_rank", f"""
WITH y AS (SELECT *, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat),
n AS (SELECT symbol, {', '.join(f'count(*) FILTER (sign({c}) = sign(y)) AS {c}' for c in _AGREE)} FROM y GROUP BY 1)
SELECT symbol, feature, importance, rank() OVER (PARTITION BY symbol ORDER BY importance DESC) + (count(*) OVER (PARTITION BY symbol, importance) - 1) / 2.0::DOUBLE AS rank
FROM n UNPIVOT (importance FOR feature IN ({', '.join(_AGREE)}))""")
def _(t):
    """Features of each symbol by how often their sign met the next return's, best first, ties averaged."""
    f = feat.price_features(t.bars()).withColumn("y", F.lead("ret_1d").over(win.per("symbol")))
    return ranks.importance_ranks(f, _AGREE, "y")


@query("gat_15_carry_forward", f"""WITH {_CRIT}, p AS (SELECT target, regime FROM cr GROUP BY 1, 2 HAVING bool_and(value >= threshold))
SELECT target, array_to_string(list(regime ORDER BY regime), ',') AS regimes FROM p GROUP BY 1""")
def _(t):
    return gat.carry_forward(criteria(t)).select("target", F.concat_ws(",", "regimes").alias("regimes"))


@query("gat_08_materiality_borda", f"""WITH {_CRIT}, m AS (SELECT target, regime, min(value / threshold) AS margin FROM cr GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY regime ORDER BY margin)::DOUBLE AS rank FROM m)
SELECT target, regime, {r6('margin','margin',5)}, rank, sum(rank) OVER (PARTITION BY target) AS borda_total FROM k""")
def _(t):
    return gat.materiality_margins(criteria(t)).select("target", "regime", r("margin", "margin", 5), F.col("rank").cast("double").alias("rank"), F.col("borda_total").cast("double").alias("borda_total"))


@query("gat_03_target_gate", f"""WITH {_CRIT}, {_PV}, {positions_sql('pv', 'regime', 1000, 0)},
d AS (SELECT regime, replicate, avg(variant) / stddev_samp(variant) * sqrt(252) - avg(baseline) / stddev_samp(baseline) * sqrt(252) AS delta FROM po JOIN (SELECT regime, i AS pos, variant, baseline FROM pl) USING (regime, pos) GROUP BY 1, 2),
ci AS (SELECT regime, quantile_cont(delta, 0.05) > 0 OR quantile_cont(delta, 0.95) < 0 AS off FROM d GROUP BY 1),
p AS (SELECT regime, bool_and(value >= threshold) AS material FROM cr WHERE target = 'rev' AND regime IN ('qe_bull', 'covid', 'rate_cycle') GROUP BY 1),
s AS (SELECT v.ts, abs(b.err) - abs(v.err) AS skill FROM scheme_daily v JOIN scheme_daily b ON v.ts = b.ts AND v.scheme = 'rev' AND b.scheme = 'long')
SELECT 'rev' AS target, count(CASE WHEN material THEN 1 END) AS material_pass_count, bool_or(off) AS significance_passed, (SELECT avg(skill) > 0 FROM s) AS deflation_passed,
 count(CASE WHEN material THEN 1 END) >= 2 AND bool_or(off) AND (SELECT avg(skill) > 0 FROM s) AS gate_passed FROM p JOIN ci USING (regime)""")
def _(t):
    ci = st.bootstrap_delta_ci(paired(t), ["regime"]).withColumn("target", F.lit("rev"))
    err = paired(t, "err").select(F.lit("rev").alias("target"), (F.abs("baseline") - F.abs("variant")).alias("skill"))
    out = gat.target_gate(criteria(t).where("target = 'rev'"), ci, st.skill_z(err, ["target"]))
    return out.select("target", "material_pass_count", "significance_passed", "deflation_passed", "gate_passed")


@query("gat_05_feature_gate", f"""WITH {_SM}, li AS (SELECT v.run AS set_name, v.regime, v.sharpe - b.sharpe AS lift FROM sm v JOIN sm b ON b.run = 'long' AND b.regime = v.regime WHERE v.run <> 'long' AND v.regime <> 'aggregate'),
sc AS (SELECT *, count(CASE WHEN lift > 0 THEN 1 END) OVER (PARTITION BY set_name) >= 2 AS sign_consistent FROM li), {_PV}, {positions_sql('pv', 'regime', 1000, 0)},
d AS (SELECT regime, replicate, avg(variant) / stddev_samp(variant) * sqrt(252) - avg(baseline) / stddev_samp(baseline) * sqrt(252) AS delta FROM po JOIN (SELECT regime, i AS pos, variant, baseline FROM pl) USING (regime, pos) GROUP BY 1, 2),
ci AS (SELECT 'rev' AS set_name, regime, quantile_cont(delta, 0.05) AS ci_low, quantile_cont(delta, 0.95) AS ci_high FROM d GROUP BY 2)
SELECT set_name, regime, {r6('lift','lift',5)}, sign_consistent FROM sc LEFT JOIN ci USING (set_name, regime) WHERE lift >= 0.1 AND (coalesce(ci_low > 0 OR ci_high < 0, false) OR sign_consistent)
QUALIFY row_number() OVER (PARTITION BY set_name ORDER BY lift DESC) = 1""")
def _(t):
    m = scheme_metrics(t).where("regime <> 'aggregate'")
    from tidemark.operators.panel import lift_over

    lifts = lift_over(m, "long", ["regime"]).select(F.col("run").alias("set_name"), "regime", "lift")
    ci = st.bootstrap_delta_ci(paired(t), ["regime"]).withColumn("set_name", F.lit("rev"))
    return gat.qualifying_features(lifts, ci).select("set_name", "regime", r("lift", "lift", 5), "sign_consistent")


@query("gat_06_attribution_gate", f"""WITH {PERMUTED},
x AS (SELECT rho, p_value, rho >= 0.5 AS materiality_passed, p_value < 0.05 AS significance_passed FROM pm),
rp AS (SELECT corr(k.ra, q.rq) AS reproduction_rho FROM k JOIN (SELECT feature, rank() OVER (ORDER BY p)::DOUBLE AS rq FROM {abs_corr_sql('p', "ts < TIMESTAMP '1998-01-01'")}) q USING (feature))
SELECT {r6('rho','rho')}, {r6('p_value','p_value')}, materiality_passed, significance_passed, {r6('reproduction_rho','reproduction_rho')},
  materiality_passed AND significance_passed AND reproduction_rho >= 0.9 AS gate_passed FROM x, rp""")
def _(t):
    """The reference signal is rebuilt from a history that ends a year earlier."""
    views = t.once("importance_views", lambda: importance_views(t, again="1998-01-01"))
    agree = st.rank_agreement(views, [], "a", "b", seed=5)
    out = gat.attribution_gate(agree, ranks.spearman(views.withColumn("_k", F.lit(1)), ["_k"], "a", "c"))
    return out.select(r("rho", "rho"), r("p_value", "p_value"), "materiality_passed", "significance_passed", r("reproduction_rho", "reproduction_rho"), "gate_passed")


@query("abl_09_attribution_status", f"""
WITH s AS (SELECT symbol, ts, ret_21d AS a, ret_5d AS p, vol_63d IS NOT NULL AS ok FROM px_feat)
SELECT symbol, CASE WHEN a IS NOT NULL AND p IS NOT NULL AND ok AND sign(a) = sign(p) THEN 'agreed' WHEN a IS NOT NULL AND p IS NOT NULL THEN 'both'
 WHEN a IS NOT NULL THEN 'ablation_only' WHEN p IS NOT NULL THEN 'oos_permutation' ELSE 'none' END AS status, count(*) AS n FROM s GROUP BY 1, 2""")
def _(t):
    from tidemark.operators.features import price_features

    f = price_features(t.bars()).withColumn("status", gat.attribution_status(F.col("ret_21d"), F.col("ret_5d"), F.col("vol_63d").isNotNull()))
    return f.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"))


#: Candidate sets of the feature gate: the sign of one feature each, against always long.
GATED = ("ret_5d", "ret_21d", "mom_21d", "rsi_gap")
_SETS = f"""
fy AS (SELECT symbol, ts, ret_5d, ret_21d, mom_21d, rsi_14 - 50 AS rsi_gap, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat),
ds AS (SELECT ts, coalesce(any_value(e.name), 'pre_qe') AS regime, avg(y) AS baseline, {', '.join(f'avg(sign({c}) * y) AS {c}' for c in GATED)}
  FROM fy LEFT JOIN eras e ON CAST(ts AS DATE) BETWEEN lo AND hi WHERE y IS NOT NULL GROUP BY 1),
sv AS MATERIALIZED (SELECT set_name, regime, ts, variant, baseline FROM ds UNPIVOT (variant FOR set_name IN ({', '.join(GATED)}))),
li AS (SELECT set_name, regime, {{v}} - {{b}} AS lift FROM sv GROUP BY 1, 2)""".replace(
    "{v}", "CASE WHEN stddev_samp(variant) > 0 THEN avg(variant) / stddev_samp(variant) * sqrt(252) ELSE 0 END").replace(
    "{b}", "CASE WHEN stddev_samp(baseline) > 0 THEN avg(baseline) / stddev_samp(baseline) * sqrt(252) ELSE 0 END")


@query("gat_05_feature_gate_sets", f"""WITH {_SETS}, {positions_sql('sv', 'set_name, regime', 1000, 0)},
d AS (SELECT set_name, regime, replicate, avg(variant) / stddev_samp(variant) * sqrt(252) - avg(baseline) / stddev_samp(baseline) * sqrt(252) AS delta
  FROM po JOIN (SELECT set_name, regime, i AS pos, variant, baseline FROM pl) USING (set_name, regime, pos) GROUP BY 1, 2, 3),
ci AS (SELECT set_name, regime, quantile_cont(delta, 0.05) > 0 OR quantile_cont(delta, 0.95) < 0 AS off FROM d GROUP BY 1, 2),
sc AS (SELECT *, count(CASE WHEN lift > 0 THEN 1 END) OVER (PARTITION BY set_name) >= 2 AS consistent FROM li),
q AS (SELECT DISTINCT set_name FROM sc JOIN ci USING (set_name, regime) WHERE lift >= 0.1 AND (off OR consistent))
SELECT (SELECT count(*) FROM q) AS n_qualifying, count(DISTINCT set_name) AS n_candidates, (SELECT count(*) FROM q) >= 3 AS gate_passed FROM li""")
def _(t):
    """Four candidate sets, each with its lift and interval per regime."""
    from tidemark.operators.features import price_features
    from tidemark.operators.labels import forward_return

    f = price_features(t.bars()).withColumns({"rsi_gap": F.col("rsi_14") - 50, "y": forward_return(1)}).where("y IS NOT NULL")
    daily = reg.tag(f.groupBy("ts").agg(F.avg("y").alias("baseline"), *[F.avg(F.signum(c) * F.col("y")).alias(c) for c in GATED]), reg.era_detector(ERAS))
    cells = ", ".join(f"'{c}', {c}" for c in GATED)
    pairs = materialized(daily.select("ts", "regime", "baseline", F.expr(f"stack({len(GATED)}, {cells}) AS (set_name, variant)")).where("variant IS NOT NULL"))
    lifts = pairs.groupBy("set_name", "regime").agg((met.sharpe("variant") - met.sharpe("baseline")).alias("lift"))
    return gat.feature_gate(lifts, st.bootstrap_delta_ci(pairs, ["set_name", "regime"])).select("n_qualifying", "n_candidates", "gate_passed")


@query("gat_07_exit_tests", f"""
WITH RECURSIVE x AS (SELECT ts, ret FROM scheme_daily WHERE scheme = 'rev'), {positions_sql('x', '', 2000, 42, kind='moving')},
bs AS (SELECT replicate, avg(ret) / stddev_pop(ret) * sqrt(252) AS s FROM po JOIN (SELECT i AS pos, ret FROM pl) USING (pos) GROUP BY 1),
ns AS (SELECT DISTINCT 74 AS n FROM region), {MAX_SHARPE},
m AS (SELECT count(*) AS n_obs, avg(ret) / stddev_samp(ret) * sqrt(252) AS sr, skewness(ret) AS sk, kurtosis(ret) AS ku,
  avg(CASE WHEN ts < TIMESTAMP '1999-01-01' THEN ret END) / stddev_samp(CASE WHEN ts < TIMESTAMP '1999-01-01' THEN ret END) * sqrt(252) AS s_in,
  avg(CASE WHEN ts >= TIMESTAMP '1999-01-01' THEN ret END) / stddev_samp(CASE WHEN ts >= TIMESTAMP '1999-01-01' THEN ret END) * sqrt(252) AS s_out FROM x),
z AS (SELECT (sr - 0.35 * unit_max) / sqrt(252) * sqrt(n_obs - 1) / sqrt(greatest(1 - sk * sr / sqrt(252) + (ku + 2) / 4 * sr * sr / 252, 1e-12)) AS z FROM m, ms),
er AS (SELECT a.ts, 'rev' AS run, a.err AS err_a, b.err AS err_b FROM scheme_daily a JOIN scheme_daily b ON a.ts = b.ts AND a.scheme = 'rev' AND b.scheme = 'mom'),
dm AS (SELECT {t_cdf_sql('statistic', '(n_obs - 1)')} AS p_value FROM ({dm_sql('er', 'run')})),
ot AS (SELECT max(s) AS best FROM (SELECT avg(ret) / stddev_samp(ret) * sqrt(252) AS s FROM scheme_daily WHERE scheme <> 'rev' GROUP BY scheme)),
dd AS (SELECT min(e / pk - 1) AS depth FROM (SELECT e, max(e) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM (SELECT ts, product(1 + ret) OVER (ORDER BY ts) AS e FROM x))),
w AS (SELECT quantile_cont(s, 0.025) > 0 AS t1, (SELECT s_out > 0 AND s_in / s_out < 2 FROM m) AS t2, (SELECT sr FROM m) > (SELECT best FROM ot) AS t3,
  (SELECT z > 0 FROM z) AS t4, (SELECT p_value < 0.05 FROM dm) AS t5, (SELECT depth > -0.25 FROM dd) AS t6 FROM bs),
u AS (SELECT unnest(['sharpe_ci', 'is_oos_ratio', 'beats_baselines', 'deflation', 'diebold_mariano', 'drawdown']) AS test, unnest([t1, t2, t3, t4, t5, t6]) AS passed FROM w)
SELECT 'rev' AS run, test, passed, count(CASE WHEN passed THEN 1 END) OVER () AS n_passed FROM u""")
def _(t):
    """The six tests of one strategy: interval, in- to out-of-sample, baselines, deflation, forecast test, drawdown."""
    d = scheme_daily(t)
    own = d.where("scheme = 'rev'")
    late = F.col("ts") >= "1999-01-01"
    one = F.lit("rev").alias("run")
    ci = st.moving_block_sharpe_ci(own, ["scheme"]).select(one, "ci_low")
    halves = own.groupBy("scheme").agg(met.sharpe(F.when(~late, F.col("ret"))).alias("s_in"), met.sharpe(F.when(late, F.col("ret"))).alias("s_out")).select(one, "s_in", "s_out")
    per = d.groupBy("scheme").agg(met.sharpe("ret").alias("s"))
    base = per.agg(F.max(F.when(F.col("scheme") == "rev", F.col("s"))).alias("s"), F.max(F.when(F.col("scheme") != "rev", F.col("s"))).alias("best")).select(one, "s", "best")
    dsr = st.deflated_sharpe(own, ["scheme"], 74).select(one, F.col("passed").alias("deflated"))
    wide = d.groupBy("ts").agg(F.max(F.when(F.col("scheme") == "rev", F.col("err"))).alias("err_a"), F.max(F.when(F.col("scheme") == "mom", F.col("err"))).alias("err_b"))
    dm = st.diebold_mariano(wide.withColumn("run", F.lit("rev")), ["run"]).select("run", "p_value")
    depth = met.return_metrics(own, ["scheme"]).select(one, "max_drawdown")
    row = ci
    for other in (halves, base, dsr, dm, depth):
        row = row.join(other, "run")
    return gat.exit_tests(row, {
        "sharpe_ci": F.col("ci_low") > 0, "is_oos_ratio": (F.col("s_out") > 0) & (F.col("s_in") / F.nullif("s_out", F.lit(0.0)) < 2), "beats_baselines": F.col("s") > F.col("best"),
        "deflation": F.col("deflated"), "diebold_mariano": F.col("p_value") < 0.05, "drawdown": F.col("max_drawdown") > -0.25})


@query("gat_14_leak_verdict", f"""
WITH s AS (SELECT symbol, avg(CASE WHEN sign(ret_5d) <> sign(ret_21d) THEN 1.0 ELSE 0.0 END) AS flips, avg(CASE WHEN ret_5d IS DISTINCT FROM ret_21d THEN 1.0 ELSE 0.0 END) AS changed, max(abs(ret_1d)) AS shift FROM px_feat GROUP BY 1)
SELECT symbol, CASE WHEN flips > 0.05 OR shift > 0.1 THEN 'LEAK CONFIRMED + MATERIAL' WHEN changed > 0 OR shift <> 0 THEN 'LEAK CONFIRMED + IMMATERIAL' ELSE 'NO MECHANICAL SENSITIVITY' END AS verdict FROM s""")
def _(t):
    from tidemark.operators.features import price_features

    f = price_features(t.bars())
    flips = F.avg(F.when(F.signum("ret_5d") != F.signum("ret_21d"), 1.0).otherwise(0.0))
    changed = F.avg(F.when(F.col("ret_5d").eqNullSafe(F.col("ret_21d")), 0.0).otherwise(1.0))
    return f.groupBy("symbol").agg(gat.leak_verdict(flips, F.max(F.abs("ret_1d")), changed).alias("verdict"))


# --- report tables on the same metrics ------------------------------------------------------
@query("tab_02_scheme_by_regime", f"""WITH {_SM} SELECT run, {', '.join(r6(f"max(CASE WHEN regime = '{g}' THEN sharpe END)", g) for g in ('aggregate', *REGIMES))} FROM sm GROUP BY 1""")
def _(t):
    w = rpt.scheme_by_regime(scheme_metrics(t), REGIMES)
    return w.select("run", *[r(c, c) for c in ("aggregate", *REGIMES)])


@query("tab_03_composite_ranking", f"""WITH {_SM}, k AS (SELECT run, avg(rk) AS mean_rank FROM (SELECT run, rank() OVER (PARTITION BY regime ORDER BY sharpe DESC NULLS LAST) AS rk FROM sm) GROUP BY 1)
SELECT run, {r6('mean_rank','mean_rank')}, CAST(rank() OVER (ORDER BY mean_rank) AS BIGINT) AS composite_rank FROM k""")
def _(t):
    return rpt.composite_ranking(scheme_metrics(t)).select("run", r("mean_rank", "mean_rank"), "composite_rank")


@query("tab_04_delta_to_baseline", f"""WITH {_SM} SELECT v.run, v.regime, {r6("CASE WHEN v.run = 'long' THEN v.sharpe ELSE v.sharpe - b.sharpe END",'delta')}, v.n_bars FROM sm v JOIN sm b ON b.run = 'long' AND b.regime = v.regime""")
def _(t):
    return rpt.delta_to_baseline(scheme_metrics(t), "long").select("run", "regime", r("delta", "delta"), "n_bars")


@query("srt_08_best_regime", f"""WITH {_SM}, d AS (SELECT v.run, v.regime, v.sharpe - b.sharpe AS delta FROM sm v JOIN sm b ON b.run = 'long' AND b.regime = v.regime WHERE v.run <> 'long')
SELECT run, {r6('max(delta)','best_delta')}, arg_max(regime, delta) AS best_regime FROM d GROUP BY 1""")
def _(t):
    out = rpt.best_regime(rpt.delta_to_baseline(scheme_metrics(t), "long").where("run <> 'long'"))
    return out.select("run", r("best_delta", "best_delta"), "best_regime")


@query("srt_05_top_features", f"""
SELECT feature, {r6('a','importance')} FROM (SELECT {', '.join(f'abs(corr({c}, y)) AS {c}' for c in FEATS)} FROM (SELECT f.*, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat f) WHERE ts < TIMESTAMP '1999-01-01')
UNPIVOT (a FOR feature IN ({', '.join(FEATS)})) ORDER BY a DESC LIMIT 4""")
def _(t):
    return importance_views(t).orderBy(F.col("a").desc()).limit(4).select("feature", r("a", "importance"))


@query("agg_29_share_of_total", f"""
SELECT feature, {r6('a / sum(a) OVER ()','share')} FROM (SELECT {', '.join(f'abs(corr({c}, y)) AS {c}' for c in FEATS)} FROM (SELECT f.*, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat f) WHERE ts < TIMESTAMP '1999-01-01')
UNPIVOT (a FOR feature IN ({', '.join(FEATS)}))""")
def _(t):
    return rpt.share_of_total(importance_views(t), [], "a").select("feature", r("share", "share"))
