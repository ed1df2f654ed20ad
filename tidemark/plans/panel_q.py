"""Model, panel, ablation and attribution queries."""
from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.operators import labels as lab
from tidemark.operators import metrics as met
from tidemark.operators import models as mod
from tidemark.operators import panel as pan
from tidemark.operators import regimes as reg
from tidemark.operators import replay as rep
from tidemark.operators import splits as spl
from tidemark.operators import windows as win
from tidemark.plans.evaluation_q import _COST as COST
from tidemark.plans.oracle_ctes import uniform_sql
from tidemark.plans.registry import query, r6
from tidemark.plans.sql_parts import fold_ctes, metrics_sql, replay_ctes
from tidemark.sources.lake import materialized

ERAS = (("qe_bull", "1996-07-01", "1998-06-30"), ("covid", "1998-07-01", "1999-12-31"),
        ("rate_cycle", "2000-01-01", "2099-12-31"))
WF = spl.WalkForward(horizon=1)
LONG = spl.WalkForward(train=1008, test=504, step=504, embargo=3, horizon=1)


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


def panel(t, *columns):
    bars = t.bars().select("symbol", "ts", "open", "close", "volume", lab.forward_return(1).alias("y"))
    f = feat.price_features(bars, columns)
    return spl.with_positions(materialized(f.select("symbol", "ts", "open", "volume", *columns, "y").dropna()))


def panel_sql(*columns):
    cols = ", ".join(f"f.{c}" for c in columns)
    keep = " AND ".join(f"{c} IS NOT NULL" for c in (*columns, "y"))
    return (f"SELECT * FROM (SELECT f.symbol, f.ts, b.open, b.volume, {cols}, lead(b.\"close\") OVER (PARTITION BY f.symbol ORDER BY f.ts) / b.\"close\" - 1 AS y "
            f"FROM px_feat f JOIN bars b USING (symbol, ts)) WHERE {keep}")


# --- simple models --------------------------------------------------------------------------
@query("mod_01_always_long", f"WITH {fold_ctes(panel_sql('mom_21d'))} SELECT fold, symbol, ts, 1.0::DOUBLE AS y_pred FROM fr WHERE role = 'test'")
def _(t):
    return spl.assign_folds(panel(t, "mom_21d"), WF, ("test",)).select("fold", "symbol", "ts", F.lit(1.0).alias("y_pred"))


@query("mod_02_momentum", f"WITH {fold_ctes(panel_sql('mom_21d'))} SELECT fold, symbol, ts, mom_21d + 0.0 AS y_pred FROM fr WHERE role = 'test'")
def _(t):
    return spl.assign_folds(panel(t, "mom_21d"), WF, ("test",)).select("fold", "symbol", "ts", F.col("mom_21d").alias("y_pred"))


@query("mod_03_training_mean", f"""
WITH {fold_ctes(panel_sql('mom_21d'))}, m AS (SELECT fold, avg(y) AS y_pred FROM fr WHERE role = 'train' GROUP BY 1)
SELECT fold, symbol, ts, {r6('m.y_pred','y_pred',8)} FROM fr JOIN m USING (fold) WHERE role = 'test'""")
def _(t):
    return mod.mean_predict(panel(t, "mom_21d"), WF).select("fold", "symbol", "ts", r("y_pred", "y_pred", 8))


_AR = """
artr AS (SELECT *, lag(y) OVER (PARTITION BY fold, symbol ORDER BY ts) AS p FROM fr WHERE role = 'train'),
ft AS (SELECT fold, symbol, coalesce(regr_slope(y, p), 0) AS phi, regr_intercept(y, p) AS c, arg_max(y, ts) AS last_y, avg(y) AS av, count(y) AS n FROM artr GROUP BY 1, 2),
f2 AS (SELECT *, coalesce(c / nullif(1 - phi, 0), av) AS mu FROM ft),
te AS (SELECT fr.*, row_number() OVER (PARTITION BY fold, symbol ORDER BY ts) AS k FROM fr WHERE role = 'test'),
ap AS (SELECT fold, symbol, ts, y, open, volume, mu + pow(phi, k) * (last_y - mu) AS y_pred FROM te JOIN f2 USING (fold, symbol))"""


@query("mod_04_ar1_per_symbol", f"""
WITH {fold_ctes(panel_sql('mom_21d'))}, {_AR} SELECT fold, symbol, ts, {r6('y_pred','y_pred',8)} FROM ap""")
def _(t):
    return mod.ar1_predict(panel(t, "mom_21d"), WF).select("fold", "symbol", "ts", r("y_pred", "y_pred", 8))


@query("mod_04_ar1_pooled", f"""
WITH {fold_ctes(panel_sql('mom_21d'))},
tr AS (SELECT *, lag(y) OVER (PARTITION BY fold ORDER BY symbol, ts) AS p FROM fr WHERE role = 'train'),
ft AS (SELECT fold, regr_slope(y, p) AS phi, regr_intercept(y, p) AS c, arg_max(y, symbol || ' ' || strftime(ts, '%Y%m%d')) AS last_y FROM tr GROUP BY 1),
te AS (SELECT fr.*, row_number() OVER (PARTITION BY fold, symbol ORDER BY ts) AS k FROM fr WHERE role = 'test')
SELECT fold, symbol, ts, {r6('c / (1 - phi) + pow(phi, k) * (last_y - c / (1 - phi))','y_pred',8)} FROM te JOIN ft USING (fold)""")
def _(t):
    return mod.ar1_pooled_predict(panel(t, "mom_21d"), WF).select("fold", "symbol", "ts", r("y_pred", "y_pred", 8))


@query("mod_05_one_step_forecast", f"""
WITH h AS (SELECT symbol, ts, ret_1d AS y, lag(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM px_ret WHERE ret_1d IS NOT NULL),
f AS (SELECT symbol, regr_slope(y, p) AS phi, regr_intercept(y, p) AS c, arg_max(y, ts) AS last_y, count(y) AS n FROM h GROUP BY 1)
SELECT symbol, {r6('c / (1 - phi) + phi * (last_y - c / (1 - phi))','forecast',8)}, n AS n_train FROM f WHERE n >= 30""")
def _(t):
    h = t.bars().withColumn("y", win.pct_change("close", 1))
    return mod.one_step_forecast(h).select("symbol", r("forecast", "forecast", 8), "n_train")


# Ridge with two columns in closed form, from centred sums.
def ridge_sql(src: str, keys: str, x1: str, x2: str, alpha: float = 1.0) -> str:
    return f"""
SELECT {keys}, n, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (
  SELECT *, (s1y * (s22 + {alpha}) - s2y * s12) / ((s11 + {alpha}) * (s22 + {alpha}) - s12 * s12) AS b1,
            (s2y * (s11 + {alpha}) - s1y * s12) / ((s11 + {alpha}) * (s22 + {alpha}) - s12 * s12) AS b2 FROM (
    SELECT {keys}, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg(y) AS my, regr_sxx(y, {x1}) AS s11, regr_sxx(y, {x2}) AS s22,
           regr_sxy({x2}, {x1}) AS s12, regr_sxy(y, {x1}) AS s1y, regr_sxy(y, {x2}) AS s2y FROM {src} GROUP BY {keys}))"""


@query("mod_06_ridge", f"""
WITH {fold_ctes(panel_sql('ret_5d', 'vol_21d'))}, tr AS (SELECT * FROM fr WHERE role = 'train'), ri AS ({ridge_sql('tr', 'fold', 'ret_5d', 'vol_21d')})
SELECT fold, symbol, ts, {r6('b0 + b1 * ret_5d + b2 * vol_21d','y_pred',8)} FROM fr JOIN ri USING (fold) WHERE role = 'test'""")
def _(t):
    p = mod.ridge_predict(panel(t, "ret_5d", "vol_21d"), WF, ["ret_5d", "vol_21d"])
    return p.select("fold", "symbol", "ts", r("y_pred", "y_pred", 8))


@query("mod_09_latest_row_score", f"""
WITH p AS (SELECT f.symbol, f.ts, ret_5d, vol_21d, lead(b."close") OVER (PARTITION BY f.symbol ORDER BY f.ts) / b."close" - 1 AS y FROM px_feat f JOIN bars b USING (symbol, ts)),
c AS (SELECT * FROM p WHERE ret_5d IS NOT NULL AND vol_21d IS NOT NULL), tr AS (SELECT * FROM c WHERE y IS NOT NULL), ri AS ({ridge_sql('tr', 'symbol', 'ret_5d', 'vol_21d')})
SELECT symbol, ts, {r6('b0 + b1 * ret_5d + b2 * vol_21d','forecast',8)}, n AS n_rows FROM c JOIN ri USING (symbol) WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def _(t):
    f = feat.price_features(t.bars().withColumn("y", lab.forward_return(1)))
    return mod.latest_row_scores(f, ["ret_5d", "vol_21d"]).select("symbol", "ts", r("forecast", "forecast", 8), "n_rows")


@query("mod_07_boosted_trees")
def _(t):
    cols = ["ret_5d", "vol_21d", "rsi_14"]
    p = panel(t, *cols)
    pred = mod.boosted_tree_predict(p, LONG, cols, draws=[{"maxDepth": 2, "maxIter": 3}, {"maxDepth": 3, "maxIter": 3}], n_splits=2)
    return pred.select("fold", "symbol", "ts", r("y_pred", "y_pred", 8))


@query("mod_11_gain_importance")
def _(t):
    cols = ["ret_5d", "vol_21d", "rsi_14"]
    return mod.gain_importance(panel(t, *cols), cols, maxDepth=3, maxIter=3).select("feature", r("importance", "importance"))


def _newton_sql(steps: int, alpha: float = 1e-3) -> str:
    """Reweighted least squares of (1, ret_5d, gap), unrolled: each step solves its normal equations by Cramer's rule."""
    out = ["i0 AS (SELECT DISTINCT fold, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM tr2)"]
    for k in range(steps):
        names = ("1.0", "x1", "x2")
        cells = ", ".join([f"sum(w * {names[i]} * {names[j]}){f' + {alpha}' if i == j and i else ''} AS s{i}{j}" for i in range(3) for j in range(i, 3)]
                          + [f"sum(w * {names[i]} * z) AS r{i}" for i in range(3)])
        m = lambda put, i, j: f"r{i}" if j == put else f"s{min(i, j)}{max(i, j)}"
        det = lambda p: (f"({m(p, 0, 0)} * ({m(p, 1, 1)} * {m(p, 2, 2)} - {m(p, 1, 2)} * {m(p, 2, 1)}) - {m(p, 0, 1)} * ({m(p, 1, 0)} * {m(p, 2, 2)} - {m(p, 1, 2)} * {m(p, 2, 0)})"  # noqa: E731
                         f" + {m(p, 0, 2)} * ({m(p, 1, 0)} * {m(p, 2, 1)} - {m(p, 1, 1)} * {m(p, 2, 0)}))")
        out.append(f"""i{k + 1} AS MATERIALIZED (SELECT fold, {', '.join(f'{det(i)} / {det(None)} AS b{i}' for i in range(3))} FROM (SELECT fold, {cells} FROM (
  SELECT fold, x1, x2, p * (1 - p) AS w, eta + (lab - p) / (p * (1 - p)) AS z FROM (SELECT *, 1 / (1 + exp(-eta)) AS p FROM (
    SELECT fold, x1, x2, lab, b0 + b1 * x1 + b2 * x2 AS eta FROM tr2 JOIN i{k} USING (fold)))) GROUP BY fold))""")
    return ", ".join(out)


@query("mod_08_logistic", f"""
WITH {fold_ctes(panel_sql('ret_5d', 'rsi_14'))}, tr2 AS MATERIALIZED (SELECT fold, ret_5d AS x1, (rsi_14 - 50) / 50 AS x2, CAST(y > 0 AS DOUBLE) AS lab FROM fr WHERE role = 'train'), {_newton_sql(8)}
SELECT fold, symbol, ts, {r6('1 / (1 + exp(-(b0 + b1 * ret_5d + b2 * (rsi_14 - 50) / 50)))','y_pred')} FROM fr JOIN i8 USING (fold) WHERE role = 'test'""")
def _(t):
    p = panel(t, "ret_5d", "rsi_14").withColumn("gap", (F.col("rsi_14") - 50) / 50)
    return mod.logistic_predict(p, WF, ["ret_5d", "gap"]).select("fold", "symbol", "ts", r("y_pred", "y_pred"))


@query("mod_12_random", f"""
WITH {fold_ctes(panel_sql('mom_21d'))}, p AS (SELECT fold, ts, y, {uniform_sql("'3'", 'symbol', 'CAST(epoch(ts) AS BIGINT)')} - 0.5 AS y_pred FROM fr WHERE role = 'test'),
d AS (SELECT fold, ts, avg(coalesce(sign(y_pred), 0) * y) AS ret FROM p GROUP BY 1, 2)
SELECT fold, {r6('CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END','sharpe')}, count(*) AS n_bars FROM d GROUP BY 1""")
def _(t):
    pred = mod.random_predict(panel(t, "mom_21d"), WF, 3).withColumn("y_true", F.col("y"))
    return pan.sign_returns(pred, []).groupBy("fold").agg(r(met.sharpe("ret"), "sharpe"), F.count(F.lit(1)).alias("n_bars"))


@query("mod_10_document_scores", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 0) AS w FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the','of','und','los'))) / greatest(len(w), 1) AS p,
  len(list_filter(w, lambda x: x IN ('de','der','was'))) / greatest(len(w), 1) AS n FROM w)
SELECT doc_id, (round(p, 6) + 0.0) AS sentiment_positive, (round(n, 6) + 0.0) AS sentiment_negative, (round(p - n, 6) + 0.0) AS sentiment_score FROM s""")
def _(t):
    todo = mod.unscored(t.raw("documents"), t.raw("labels"), "doc_id")
    s = mod.lexicon_scores(todo, positive=("the", "of", "und", "los"), negative=("de", "der", "was"))  # words these texts have
    return s.select("doc_id", *[r(c, c) for c in ("sentiment_positive", "sentiment_negative", "sentiment_score")])


def _length_scorer():
    def score(texts):
        out = []
        for x in texts:
            p = (len(x) % 97) / 97.0
            out.append((p, 1 - p, 0.0))
        return out

    return score


@query("mod_10_pluggable_scorer", f"""
SELECT doc_id, {r6('p','sentiment_positive')}, {r6('1 - p','sentiment_negative')}, {r6('p - (1 - p)','sentiment_score')}, 'length' AS model_name FROM (SELECT doc_id, (length(text) % 97) / 97.0::DOUBLE AS p FROM documents)""")
def _(t):
    s = mod.score_documents(t.raw("documents"), _length_scorer, "length", "1", key="doc_id")
    return s.select("doc_id", *[r(c, c) for c in ("sentiment_positive", "sentiment_negative", "sentiment_score")], "model_name")


@query("mod_12_perfect_foresight", f"""
SELECT symbol, {r6("CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END",'sharpe')}, count(r) AS n_bars FROM (
  SELECT symbol, abs(lead("close") OVER (PARTITION BY symbol ORDER BY ts) / "close" - 1) AS r FROM bars) GROUP BY 1""")
def _(t):
    b = t.bars().withColumn("y", lab.forward_return(1))
    perfect = b.select("symbol", (F.signum("y") * F.col("y")).alias("ret"))
    return perfect.groupBy("symbol").agg(r(met.sharpe("ret"), "sharpe"), F.count("ret").alias("n_bars"))


# --- panels ---------------------------------------------------------------------------------
_SIG = f"SELECT run || '|' || fold || '|' || symbol AS g, ts, open, volume, CAST(coalesce(sign(y_pred), 0) AS INTEGER) AS signal, {COST} FROM preds"
_PORT = """port AS (SELECT split_part(g, '|', 1) AS run, CAST(split_part(g, '|', 2) AS BIGINT) AS fold, ts, avg(ret) AS ret FROM eq_ret GROUP BY 1, 2, 3)"""
_THREE = f"""{fold_ctes(panel_sql('ret_5d', 'vol_21d', 'mom_21d'))}, {_AR},
tr2 AS (SELECT * FROM fr WHERE role = 'train'), ri AS ({ridge_sql('tr2', 'fold', 'ret_5d', 'vol_21d')}),
preds AS (SELECT 'ar1' AS run, fold, symbol, ts, y, open, volume, y_pred FROM ap
  UNION ALL SELECT 'ridge', fold, symbol, ts, y, open, volume, b0 + b1 * ret_5d + b2 * vol_21d FROM fr JOIN ri USING (fold) WHERE role = 'test'
  UNION ALL SELECT 'long', fold, symbol, ts, y, open, volume, 1.0 FROM fr WHERE role = 'test')"""


def three_models(t):
    cols = ["ret_5d", "vol_21d"]
    long_only = lambda p, wf: spl.assign_folds(p, wf, ("test",)).withColumn("y_pred", F.lit(1.0))
    return pan.collect_predictions(panel(t, *cols, "mom_21d"), WF, {
        "ar1": mod.ar1_predict, "ridge": lambda p, wf: mod.ridge_predict(p, wf, cols), "long": long_only})


@query("abl_04_collect_predictions", f"""WITH {_THREE}
SELECT run, fold, symbol, ts, {r6('y','y_true')}, {r6('y_pred','y_pred',8)} FROM preds""")
def _(t):
    return three_models(t).select("run", "fold", "symbol", "ts", r("y_true", "y_true"), r("y_pred", "y_pred", 8))


@query("abl_03_evaluate_models", f"""WITH RECURSIVE {_THREE}, {replay_ctes(_SIG)}, {_PORT}
SELECT run, n_bars, sharpe, sortino, max_drawdown FROM ({metrics_sql('port', 'run')})""")
def _(t):
    m = pan.evaluate(three_models(t))
    return m.select("run", "n_bars", r("sharpe", "sharpe"), r("sortino", "sortino"), r("max_drawdown", "max_drawdown"))


@query("abl_11_target_arm", f"""WITH RECURSIVE {fold_ctes(panel_sql('mom_21d'))},
preds AS (SELECT symbol, ts, open, volume, 1 / (1 + exp(-mom_21d)) AS p FROM fr WHERE role = 'test'),
{replay_ctes("SELECT symbol AS g, ts, open, volume, CAST(sign(p - 0.5) AS INTEGER) AS signal, " + COST + " FROM preds")}
SELECT ts, {r6('avg(ret)','ret')}, count(*) AS n_symbols FROM eq_ret GROUP BY 1""")
def _(t):
    p = spl.assign_folds(panel(t, "mom_21d"), WF, ("test",)).withColumns({"y_pred": 1 / (1 + F.exp(-F.col("mom_21d"))), "run": F.lit("dir")})
    return pan.directional_returns(p).select("ts", r("ret", "ret"), "n_symbols")


_SETS = pan.add_one_sets(["ret_5d"], ["vol_21d", "rsi_14"])


def _one(x):
    return f"""SELECT fold, my - b1 * m1 AS b0, b1 FROM (SELECT fold, avg({x}) AS m1, avg(y) AS my, regr_sxy(y, {x}) / (regr_sxx(y, {x}) + 1.0) AS b1 FROM tr2 GROUP BY 1)"""


_ADD1 = f"""{fold_ctes(panel_sql('ret_5d', 'vol_21d', 'rsi_14'))}, tr2 AS (SELECT * FROM fr WHERE role = 'train'), te2 AS (SELECT * FROM fr WHERE role = 'test'),
r0 AS ({_one('ret_5d')}), r1 AS ({ridge_sql('tr2', 'fold', 'ret_5d', 'vol_21d')}), r2 AS ({ridge_sql('tr2', 'fold', 'ret_5d', 'rsi_14')}),
preds AS (SELECT 'baseline' AS run, fold, symbol, ts, y, open, volume, b0 + b1 * ret_5d AS y_pred FROM te2 JOIN r0 USING (fold)
  UNION ALL SELECT 'baseline+vol_21d', fold, symbol, ts, y, open, volume, b0 + b1 * ret_5d + b2 * vol_21d FROM te2 JOIN r1 USING (fold)
  UNION ALL SELECT 'baseline+rsi_14', fold, symbol, ts, y, open, volume, b0 + b1 * ret_5d + b2 * rsi_14 FROM te2 JOIN r2 USING (fold))"""


def add_one(t):
    return pan.ridge_set_predictions(panel(t, "ret_5d", "vol_21d", "rsi_14"), WF, _SETS)


@query("abl_06_feature_set_predictions", f"WITH {_ADD1} SELECT run, fold, symbol, ts, {r6('y_pred','y_pred',8)} FROM preds")
def _(t):
    return add_one(t).select("run", "fold", "symbol", "ts", r("y_pred", "y_pred", 8))


_ERA_PORT = "pe AS (SELECT port.run, port.ts, port.ret, coalesce(eras.name, 'pre_qe') AS regime FROM port LEFT JOIN eras ON CAST(ts AS DATE) BETWEEN lo AND hi)"


def set_regime_metrics(t):
    ret = pan.ridge_set_returns(panel(t, "ret_5d", "vol_21d", "rsi_14"), WF, _SETS)
    ret = reg.tag(ret, reg.era_detector(ERAS))
    return met.regime_metrics(ret, ["run"])


@query("abl_06_feature_set_lift", f"""WITH RECURSIVE {_ADD1}, {replay_ctes(_SIG)}, {_PORT}, {_ERA_PORT},
b AS (SELECT run, ts, ret, regime FROM pe UNION ALL SELECT run, ts, ret, 'aggregate' FROM pe), m AS ({metrics_sql('b', 'run, regime')})
SELECT m.run, m.regime, m.n_bars, m.sharpe, {r6('m.sharpe - z.sharpe','lift',5)} FROM m JOIN m z ON z.run = 'baseline' AND z.regime = m.regime WHERE m.run <> 'baseline'""")
def _(t):
    out = pan.lift_over(set_regime_metrics(t).withColumn("sharpe", F.round("sharpe", 6)), "baseline", ["regime"])
    return out.select("run", "regime", "n_bars", r("sharpe", "sharpe"), r("lift", "lift", 5))


_LOO = pan.leave_one_out_sets(["ret_5d", "vol_21d", "rsi_14"])


def ridge3_sql(src: str, keys: str, x: tuple[str, str, str], alpha: float = 1.0) -> str:
    """Ridge with three columns by Cramer's rule, from centred sums."""
    sums = ", ".join([f"regr_sxx(y, {c}) + {alpha} AS s{i}{i}" for i, c in enumerate(x)]
                     + [f"regr_sxy({x[j]}, {x[i]}) AS s{i}{j}" for i in range(3) for j in range(i + 1, 3)]
                     + [f"regr_sxy(y, {c}) AS r{i}" for i, c in enumerate(x)] + [f"avg({c}) AS m{i}" for i, c in enumerate(x)])
    cell = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def det(put: int | None) -> str:
        m = [[f"r{i}" if j == put else cell(i, j) for j in range(3)] for i in range(3)]
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    betas = ", ".join(f"{det(i)} / {det(None)} AS b{i + 1}" for i in range(3))
    return f"""SELECT {keys}, my - b1 * m0 - b2 * m1 - b3 * m2 AS b0, b1, b2, b3 FROM (
  SELECT *, {betas} FROM (SELECT {keys}, avg(y) AS my, {sums} FROM {src} GROUP BY {keys}))"""


_SIGNED = "SELECT run, fold, ts, avg(coalesce(sign(y_pred), 0) * y) AS ret FROM preds GROUP BY 1, 2, 3"
_C3 = ("ret_5d", "vol_21d", "rsi_14")
_PAIRS = [(a, b) for a, b in ((0, 1), (0, 2), (1, 2))]


@query("abl_07_leave_one_out", f"""
WITH {fold_ctes(panel_sql(*_C3))}, tr2 AS MATERIALIZED (SELECT * FROM fr WHERE role = 'train'), te2 AS MATERIALIZED (SELECT * FROM fr WHERE role = 'test'),
r3 AS ({ridge3_sql('tr2', 'fold', _C3)}), {', '.join(f"r{a}{b} AS ({ridge_sql('tr2', 'fold', _C3[a], _C3[b])})" for a, b in _PAIRS)},
preds AS (SELECT 'all' AS run, fold, ts, y, b0 + b1 * {_C3[0]} + b2 * {_C3[1]} + b3 * {_C3[2]} AS y_pred FROM te2 JOIN r3 USING (fold)
  {' '.join(f"UNION ALL SELECT '{_C3[3 - a - b]}', fold, ts, y, b0 + b1 * {_C3[a]} + b2 * {_C3[b]} FROM te2 JOIN r{a}{b} USING (fold)" for a, b in _PAIRS)}),
port AS ({_SIGNED}), s AS (SELECT run, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS s FROM port GROUP BY 1),
i AS (SELECT a.run AS feature, z.s - a.s AS importance FROM s a, s z WHERE z.run = 'all' AND a.run <> 'all')
SELECT feature, {r6('importance','importance')}, rank() OVER (ORDER BY importance DESC) + (count(*) OVER (PARTITION BY importance) - 1) / 2.0::DOUBLE AS rank FROM i""")
def _(t):
    p = pan.ridge_set_predictions(panel(t, *_C3), WF, _LOO)
    sharpes = pan.sign_returns(p).groupBy("run").agg(met.sharpe("ret").alias("sharpe"))
    return pan.leave_one_out_attribution(sharpes).select("feature", r("importance", "importance"), "rank")


def _placed(columns: tuple[str, ...], repeats: int) -> str:
    """Test rows under every feature and repeat with the shuffled value: both places, one equi-join."""
    return f"""{fold_ctes(panel_sql('ret_5d', 'rsi_14'))}, te2 AS MATERIALIZED (SELECT * FROM fr WHERE role = 'test'),
x AS (SELECT feature, rep, fold, symbol, ts, CASE feature WHEN 'ret_5d' THEN ret_5d ELSE rsi_14 END AS x FROM te2, unnest({list(columns)}) f(feature), generate_series(1, {repeats}) t(rep)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY feature, rep, fold, symbol ORDER BY ts) AS i, row_number() OVER (PARTITION BY feature, rep, fold, symbol ORDER BY
 substr(md5('0|' || feature || '|' || rep || '|' || symbol || '|' || CAST(epoch(ts) AS BIGINT)), 1, 12), ts) AS j FROM x),
sh AS (SELECT a.feature, a.rep, a.fold, a.symbol, a.ts, a.x, b.x AS shuffled FROM o a JOIN o b ON a.feature = b.feature AND a.rep = b.rep AND a.fold = b.fold AND a.symbol = b.symbol AND a.i = b.j)"""


@query("abl_08_permutation_importance", f"""
WITH {_placed(('ret_5d', 'rsi_14'), 10)}, tr2 AS MATERIALIZED (SELECT * FROM fr WHERE role = 'train'), ri AS ({ridge_sql('tr2', 'fold', 'ret_5d', 'rsi_14')}),
base AS MATERIALIZED (SELECT fold, symbol, ts, y, b0 + b1 * ret_5d + b2 * rsi_14 AS p, b1, b2 FROM te2 JOIN ri USING (fold)),
bs AS (SELECT fold, {{s}} AS s FROM (SELECT fold, ts, avg(coalesce(sign(p), 0) * y) AS ret FROM base GROUP BY 1, 2) GROUP BY 1),
ps AS (SELECT feature, rep, fold, {{s}} AS s FROM (SELECT feature, rep, fold, ts, avg(coalesce(sign(p + CASE feature WHEN 'ret_5d' THEN b1 ELSE b2 END * (shuffled - x)), 0) * y) AS ret
  FROM sh JOIN base USING (fold, symbol, ts) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
lo AS (SELECT feature, rep, avg(bs.s - ps.s) AS loss FROM ps JOIN bs USING (fold) GROUP BY 1, 2)
SELECT feature, {r6('avg(loss)','importance')}, {r6('stddev_samp(loss) / sqrt(count(loss))','std_error')} FROM lo GROUP BY 1""".replace(
    "{s}", "CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END"))
def _(t):
    cols = ["ret_5d", "rsi_14"]
    p = materialized(pan.ridge_set_predictions(panel(t, *cols), WF, {"all": cols}))
    out = pan.permutation_importance(p, cols, cols, returns=pan.sign_returns)
    return out.select("feature", r("importance", "importance"), r("std_error", "std_error"))


@query("abl_08_shuffled_column", f"""WITH {_placed(('ret_5d',), 2)} SELECT fold, symbol, ts, CAST(rep AS INTEGER) AS "repeat", {r6('shuffled','shuffled')} FROM sh""")
def _(t):
    cols = ["ret_5d", "rsi_14"]
    # A unit coefficient and a zero prediction make the shuffled value itself visible.
    rows = spl.assign_folds(panel(t, *cols), WF, ("test",)).withColumns({"beta": F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), "y_pred": F.col("ret_5d")})
    out = pan.permuted_predictions(rows, cols, ["ret_5d"], 2)
    return out.select("fold", "symbol", "ts", "repeat", r("y_pred", "shuffled"))


#: Label schemes as callables, each with the bars it looks ahead.
SCHEMES = {"next_bar": pan.LabelScheme(lambda: F.col("earned"), 1), "five_bars": pan.LabelScheme(lambda: F.col("five"), 5),
           "scaled": pan.LabelScheme(lambda: F.col("five") / F.col("vol_21d"), 5), "direction": pan.LabelScheme(lambda: F.signum("earned"), 1)}


def _scheme_sql(name: str, y: str, gap: int) -> str:
    src = f"SELECT symbol, ts, earned, ret_5d, rsi_14, {y} AS y FROM l WHERE ret_5d IS NOT NULL AND rsi_14 IS NOT NULL AND {y} IS NOT NULL"
    return f"""(WITH {fold_ctes(src, gap=gap)}, tr2 AS (SELECT * FROM fr WHERE role = 'train'), ri AS ({ridge_sql('tr2', 'fold', 'ret_5d', 'rsi_14')})
SELECT '{name}' AS run, fold, ts, y AS y_true, earned AS y, b0 + b1 * ret_5d + b2 * rsi_14 AS y_pred FROM fr JOIN ri USING (fold) WHERE role = 'test')"""


@query("abl_05_label_ablation", f"""
WITH l AS MATERIALIZED (SELECT f.symbol, f.ts, ret_5d, rsi_14, vol_21d, lead(b."close", 1) OVER w / b."close" - 1 AS earned, lead(b."close", 5) OVER w / b."close" - 1 AS y5
  FROM px_feat f JOIN bars b USING (symbol, ts) WINDOW w AS (PARTITION BY f.symbol ORDER BY f.ts)),
preds AS ({' UNION ALL '.join(_scheme_sql(*x) for x in (('next_bar', 'earned', 4), ('five_bars', 'y5', 8), ('scaled', 'y5 / vol_21d', 8), ('direction', 'sign(earned)', 4)))}),
er AS (SELECT run, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg(CAST(sign(y_true) = sign(y_pred) AS DOUBLE)) AS hit_rate, count(*) AS n_predictions FROM preds GROUP BY 1),
port AS (SELECT * FROM ({_SIGNED}))
SELECT run, n_bars, total_return, sharpe, max_drawdown, {r6('rmse','rmse')}, {r6('hit_rate','hit_rate')}, n_predictions FROM ({metrics_sql('port', 'run')}) JOIN er USING (run)""")
def _(t):
    # What looks ahead is taken in the windows of the price columns; only what labels and models read is written.
    bars = t.bars().select("symbol", "ts", "close").withColumns({"earned": lab.forward_return(1), "five": lab.forward_return(5)})
    f = materialized(feat.price_features(bars, ["ret_5d", "rsi_14", "vol_21d"]).select("symbol", "ts", "earned", "five", "ret_5d", "rsi_14", "vol_21d"))
    pred = pan.label_ablation(f, SCHEMES, ["ret_5d", "rsi_14"], WF)
    off = F.col("y_true") - F.col("y_pred")
    # Forecasts are made once and not written: a row per scheme, fold and bar of the calendar is.
    daily = materialized(pred.groupBy("run", "fold", "ts").agg(
        pan.sign_return("earned").alias("ret"), F.sum(off * off).alias("off2"), F.sum((F.signum("y_true") == F.signum("y_pred")).cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n")))
    m = met.return_metrics(daily.select("run", "fold", "ts", "ret"), ["run"])
    errors = daily.groupBy("run").agg(F.sqrt(F.sum("off2") / F.sum("n")).alias("rmse"), (F.sum("hits") / F.sum("n")).alias("hit_rate"), F.sum("n").alias("n_predictions"))
    return m.join(errors, "run").select("run", "n_bars", r("total_return", "total_return", 4), *[r(c, c) for c in ("sharpe", "max_drawdown", "rmse", "hit_rate")], "n_predictions")


MACROS = list(feat.MACRO_SERIES)
_UNLAGGED = f"""un AS (SELECT day, {', '.join(f'last_value({c} IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}' for c in MACROS)}
 FROM calendar_days LEFT JOIN (SELECT greatest(CAST("timestamp" AS DATE), DATE '1995-01-01') AS day, {', '.join(f"arg_max(value, \"timestamp\") FILTER (series_id = '{c}') AS {c}" for c in MACROS)} FROM macro GROUP BY 1) USING (day)),
dy AS (SELECT DISTINCT ts, CAST(ts AS DATE) AS day FROM bars),
ab AS MATERIALIZED (SELECT symbol, ts, {', '.join(f'm.{c} - 12 AS a_{c}, un.{c} - 12 AS b_{c}' for c in MACROS)} FROM bars JOIN macro_wide m ON m.day = CAST(ts AS DATE) JOIN un ON un.day = m.day)"""


def macro_builds(t, rows):
    """Macro columns around 12 with and without publication lags."""
    from tidemark.operators.timejoin import attach_macro

    return [attach_macro(rows, t.macro(), MACROS, "1995-01-01", "2001-12-31", lags).withColumns({c: F.col(c) - 12 for c in MACROS})
            for lags in (feat.PUBLICATION_LAGS, None)]


@query("abl_12_feature_build_ab", f"WITH {_UNLAGGED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_cells, {r6(f'avg(CAST(a_{c} IS DISTINCT FROM b_{c} AS DOUBLE))','changed_share')}, {r6(f'avg(CASE WHEN sign(a_{c}) <> sign(b_{c}) THEN 1.0 ELSE 0.0 END)','sign_flip_share')} FROM ab" for c in MACROS))
def _(t):
    out = pan.build_ab(*macro_builds(t, t.bars().select("symbol", "ts")), MACROS)
    return out.select("feature", "n_cells", r("changed_share", "changed_share"), r("sign_flip_share", "sign_flip_share"))


def _shift_sql(c: str) -> str:
    lags = ", ".join(f"lag(b, {k}) OVER (ORDER BY ts) AS l{k}" for k in range(6))
    shares = ", ".join(f"avg(CAST(a = l{k} AS DOUBLE)) AS s{k}" for k in range(6))
    best = f"greatest({', '.join(f's{k}' for k in range(6))})"
    pick = " ".join(f"WHEN s{k} = {best} THEN {k}" for k in range(6))
    return f"""SELECT '{c}' AS feature, CAST(CASE {pick} END AS INTEGER) AS best_lag, {r6(best,'match_share')}, {r6('s0','same_share')} FROM (SELECT {shares} FROM (
  SELECT a, {lags} FROM (SELECT ts, m.{c} - 12 AS a, un.{c} - 12 AS b FROM dy JOIN macro_wide m USING (day) JOIN un USING (day)))
  WHERE a IS NOT NULL AND {' AND '.join(f'l{k} IS NOT NULL' for k in range(6))})"""


@query("abl_12_shift_match", f"WITH {_UNLAGGED} " + " UNION ALL ".join(_shift_sql(c) for c in MACROS))
def _(t):
    """On the dates that have bars: the lagged build is mostly the other one a bar before."""
    out = pan.shift_match(*macro_builds(t, t.bars().select("ts").distinct()), MACROS)
    return out.select("feature", "best_lag", r("match_share", "match_share"), r("same_share", "same_share"))


@query("abl_12_regime_delta", f"""WITH {_UNLAGGED},
rt AS (SELECT ab.*, lead(b."close") OVER (PARTITION BY symbol ORDER BY ts) / b."close" - 1 AS y FROM ab JOIN bars b USING (symbol, ts)),
dr AS (SELECT ts, coalesce(any_value(e.name), 'pre_qe') AS regime, avg(sign(a_DGS10) * y) AS ra, avg(sign(b_DGS10) * y) AS rb FROM rt LEFT JOIN eras e ON CAST(ts AS DATE) BETWEEN lo AND hi WHERE y IS NOT NULL GROUP BY 1),
bo AS (SELECT * FROM dr UNION ALL SELECT ts, 'aggregate', ra, rb FROM dr),
sb AS (SELECT regime, CASE WHEN stddev_samp(ra) > 0 THEN avg(ra) / stddev_samp(ra) * sqrt(252) ELSE 0 END AS a, CASE WHEN stddev_samp(rb) > 0 THEN avg(rb) / stddev_samp(rb) * sqrt(252) ELSE 0 END AS b FROM bo GROUP BY 1)
SELECT regime, {r6('a','sharpe_a')}, {r6('b','sharpe_b')}, {r6('a - b','delta')} FROM sb""")
def _(t):
    rows = t.bars().select("symbol", "ts", lab.forward_return(1).alias("y")).where("y IS NOT NULL")
    daily = [reg.tag(b.groupBy("ts").agg(F.avg(F.signum("DGS10") * F.col("y")).alias("ret")), reg.era_detector(ERAS)) for b in macro_builds(t, rows)]
    return pan.regime_delta(*daily).select("regime", *[r(c, c) for c in ("sharpe_a", "sharpe_b", "delta")])


@query("abl_13_best_baseline", f"""
SELECT regime, arg_max(scheme, s) AS best, {r6('max(s)','score')} FROM (SELECT scheme, regime, avg(ret) / stddev_samp(ret) * sqrt(252) AS s FROM scheme_daily GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    from tidemark.plans.stats_q import scheme_daily

    s = scheme_daily(t).groupBy(F.col("scheme").alias("run"), "regime").agg(met.sharpe("ret").alias("score"))
    return pan.best_baseline(s, ["regime"]).select("regime", "best", r("score", "score"))


@query("abl_14_forecast_from_errors", f"""
SELECT scheme, ts, {r6('avg(y_pred)','mean_forecast')} FROM scheme_pred GROUP BY 1, 2""")
def _(t):
    from tidemark.plans.stats_q import scheme_daily, scheme_predictions

    labels = scheme_predictions(t).where("scheme = 'long'").select("ts", F.col("y_true").alias("y"))
    out = pan.forecast_from_errors(labels, scheme_daily(t).select("scheme", "ts", "err"))
    return out.select("scheme", "ts", r("mean_forecast", "mean_forecast"))


# --- replay variants ------------------------------------------------------------------------
@query("rep_09_benchmark_growth", f"""
WITH RECURSIVE d AS (SELECT DISTINCT ts FROM bars), f AS (SELECT min(ts) AS t0 FROM bars WHERE symbol = 'S1'),
c AS (SELECT ts, last_value("close" IGNORE NULLS) OVER (ORDER BY ts) AS px FROM d LEFT JOIN (SELECT ts, "close" FROM bars WHERE symbol = 'S1') USING (ts)),
{replay_ctes("SELECT 'b' AS g, ts, px AS open, 1e15 AS volume, 1 AS signal, 0.005::DOUBLE AS fee, 5.0 / 10000 AS slip, 0.1::DOUBLE AS cap FROM c, f WHERE ts >= t0")}
SELECT ts, {r6('equity / 100000','growth')} FROM eq""")
def _(t):
    bars = t.bars()
    bench = bars.where("symbol = 'S1'").select("ts", "close")
    start = bench.agg(F.min("ts").alias("_t0")).withColumn("_k", F.lit(1))
    days = bars.select("ts").distinct().withColumn("_k", F.lit(1)).join(start, "_k").where("ts >= _t0").select("ts")
    return rep.always_long_growth(bench, days).select("ts", r("growth", "growth"))


_DEC = """SELECT symbol || '|' || k AS g, ts, open, volume, coalesce(sign("close" / lag("close", 5) OVER (PARTITION BY symbol, k ORDER BY ts) - 1), 0) AS signal,
 CASE WHEN k = 0 THEN 0.005 ELSE 0 END::DOUBLE AS fee, CASE WHEN k <= 1 THEN 5.0 ELSE 2.0 END / 10000 AS slip, 0.1::DOUBLE AS cap FROM bars, range(3) t(k)"""


def _decomposed(t):
    from tidemark.plans.evaluation_q import signalled

    return rep.cost_decomposition(signalled(t), rep.BACKTEST_COSTS, rep.Costs(0.0, 2.0, 0.10))


@query("rep_11_cost_decomposition", f"""WITH RECURSIVE {replay_ctes(_DEC)},
m AS (SELECT split_part(g, '|', 1) AS symbol, CAST(split_part(g, '|', 2) AS INTEGER) AS step, arg_max(equity, ts) / arg_min(equity, ts) AS multiple FROM eq GROUP BY 1, 2)
SELECT symbol, step, CASE step WHEN 0 THEN 'start' WHEN 1 THEN 'commission_per_share' ELSE 'slippage_bps' END AS changed, {r6('multiple','multiple')},
  {r6('multiple / lag(multiple) OVER (PARTITION BY symbol ORDER BY step) - 1','component')} FROM m""")
def _(t):
    return _decomposed(t).select("symbol", "step", "changed", r("multiple", "multiple"), r("component", "component"))


@query("rep_12_reconciliation_verdict", f"""WITH RECURSIVE {replay_ctes(_DEC)},
m AS (SELECT split_part(g, '|', 1) AS symbol, split_part(g, '|', 2) AS step, arg_max(equity, ts) / arg_min(equity, ts) AS multiple FROM eq GROUP BY 1, 2),
n AS (SELECT split_part(g, '|', 1) AS symbol, count(*) AS n_trades FROM tr WHERE split_part(g, '|', 2) = '0' GROUP BY 1)
SELECT symbol, {r6("a.multiple",'backtest_multiple')}, {r6("b.multiple",'paper_multiple')}, n_trades, {r6('b.multiple / a.multiple - 1','relative_delta')},
 n_trades > 0 AND abs(b.multiple / a.multiple - 1) <= 0.01 AS passed FROM m a JOIN m b USING (symbol) JOIN n USING (symbol) WHERE a.step = '0' AND b.step = '2'""")
def _(t):
    out = rep.reconciliation(_decomposed(t))
    return out.select("symbol", r("backtest_multiple", "backtest_multiple"), r("paper_multiple", "paper_multiple"), "n_trades", r("relative_delta", "relative_delta"), "passed")


@query("rep_14_expanding_ar1_signal", """
WITH a AS (SELECT symbol, ts, ret_1d AS y, lag(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM px_ret WHERE ret_1d IS NOT NULL),
f AS (SELECT *, regr_slope(y, p) OVER w AS phi, regr_intercept(y, p) OVER w AS c FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN n >= 100 AND (n - 100) % 63 = 0 THEN coalesce(sign(c + phi * y), 0) END AS s FROM f)
SELECT symbol, ts, CAST(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 0) AS INTEGER) AS signal FROM s""")
def _(t):
    return mod.expanding_ar1_signal(t.bars(), 63, 100).select("symbol", "ts", "signal")


@query("rep_03_equity_returns", f"""WITH RECURSIVE {replay_ctes("SELECT symbol AS g, ts, open, volume, 1 AS signal, " + COST + " FROM bars")}
SELECT g AS symbol, ts, {r6('ret','ret')} FROM eq_ret""")
def _(t):
    rows = t.bars().withColumn("signal", F.lit(1))
    return rep.replay_returns(rows, ["symbol"], rep.BACKTEST_COSTS).select("symbol", "ts", r("ret", "ret"))


@query("met_17_in_sample_metrics", f"""WITH RECURSIVE {fold_ctes(panel_sql('mom_21d'))},
{replay_ctes("SELECT role || '|' || fold || '|' || symbol AS g, ts, open, volume, CAST(mom_21d AS INTEGER) AS signal, " + COST + " FROM fr")},
p AS (SELECT split_part(g, '|', 1) AS sample, CAST(split_part(g, '|', 2) AS BIGINT) AS fold, ts, avg(ret) AS ret FROM eq_ret GROUP BY 1, 2, 3)
SELECT fold, sample, n_bars, sharpe FROM ({metrics_sql('p', 'sample, fold')})""")
def _(t):
    rows = panel(t, "mom_21d").withColumns({"_cells": spl.fold_cells(WF), "signal": rep.sign_signal("mom_21d")}).where(F.size("_cells") > 0)
    ret = rep.replay_returns(rows, ["role", "fold", "symbol"], rep.BACKTEST_COSTS, layers="_cells")
    m = met.return_metrics(rep.cross_section_mean(ret, ["role", "fold"]), ["role", "fold"])
    return m.select("fold", F.col("role").alias("sample"), "n_bars", r("sharpe", "sharpe"))
