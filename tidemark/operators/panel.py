"""Panel evaluation, ablation and attribution. All variants of a study are one job keyed by ``run``."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics as met
from tidemark.operators import replay as rep
from tidemark.operators.models import add_grams, gram, gram_cells, linear_score, solve
from tidemark.operators.splits import WalkForward, assign_folds
from tidemark.operators.stats import uniform
from tidemark.sources.lake import materialized

Forecaster = Callable[[DataFrame, WalkForward], DataFrame]


def collect_predictions(positioned: DataFrame, wf: WalkForward, models: Mapping[str, Forecaster], y: str = "y") -> DataFrame:
    """(run, fold, symbol, ts, y_true, y_pred, open, volume) of several models on the same folds."""
    out = None
    for name, model in models.items():
        part = model(positioned, wf).select(F.lit(name).alias("run"), "fold", "symbol", "ts", F.col(y).alias("y_true"),
                                            F.col("y_pred").cast("double").alias("y_pred"), "open", "volume")
        out = part if out is None else out.unionByName(part)
    return out


def portfolio_returns(pred: DataFrame, by: Sequence[str] = ("run",), costs: rep.Costs = rep.BACKTEST_COSTS) -> DataFrame:
    """Sign signals replayed per (by, fold, symbol), then averaged over symbols per bar."""
    rows = pred.withColumn("signal", rep.sign_signal("y_pred"))
    return rep.mean_returns(rows, [*by, "fold"], {"signal": "signal"}, costs).drop("signal")


def portfolio_errors(pred: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    return pred.groupBy(*by, "fold", "ts").agg(F.avg(F.col("y_true") - F.col("y_pred")).alias("err"))


def evaluate(pred: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    return met.return_metrics(portfolio_returns(pred, by), list(by))


def directional_returns(pred: DataFrame, by: Sequence[str] = ("run",), threshold: float = 0.5,
                        costs: rep.Costs = rep.BACKTEST_COSTS) -> DataFrame:
    """One continuous path per symbol across folds, for probability forecasts."""
    rows = pred.withColumn("signal", rep.sign_signal("y_pred", threshold))
    return rep.mean_returns(rows, list(by), {"signal": "signal"}, costs).drop("signal")


# --- feature sets ---------------------------------------------------------------------------
def add_one_sets(base: Sequence[str], candidates: Sequence[str]) -> dict[str, list[str]]:
    overlap = set(base) & set(candidates)
    if overlap:
        raise ValueError(f"candidates already in the baseline: {sorted(overlap)}")
    return {"baseline": list(base), **{f"baseline+{c}": [*base, c] for c in candidates}}


def leave_one_out_sets(columns: Sequence[str]) -> dict[str, list[str]]:
    return {"all": list(columns), **{f"all-{c}": [x for x in columns if x != c] for c in columns}}


def check_sets(panel: DataFrame, sets: Mapping[str, Sequence[str]]) -> None:
    """Fail before any job when a set names a column the panel lacks."""
    missing = {name: sorted(set(cols) - set(panel.columns)) for name, cols in sets.items()}
    missing = {k: v for k, v in missing.items() if v}
    if missing:
        raise ValueError(f"feature sets with unknown columns: {missing}")


def ridge_set_fits(positioned: DataFrame, wf: WalkForward, sets: Mapping[str, Sequence[str]], y: str = "y",
                   alpha: float = 1.0) -> DataFrame:
    """Ridge fits of every feature set per fold from ONE cross-product pass.

    A set's normal equations are a sub-matrix of the full one, so no set rescans the
    panel. Coefficients come back in full width, zero for columns outside the set.
    """
    columns = _set_columns(sets)
    return _set_fits(gram(positioned, ["pos", "n_days"], columns, y), wf, sets, alpha)


def _set_columns(sets: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(c for cols in sets.values() for c in cols))


def _set_fits(daily: DataFrame, wf: WalkForward, sets: Mapping[str, Sequence[str]], alpha: float) -> DataFrame:
    """The fits from cross products per date."""
    columns = _set_columns(sets)
    p = len(columns) + 2
    width = p * (p + 1) // 2
    folds = add_grams(assign_folds(daily, wf, ("train",)), ["fold"], width)
    members = {name: [0, *[columns.index(c) + 1 for c in cols]] for name, cols in sets.items()}
    ri, ci = np.triu_indices(p)

    def batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for fold, flat in zip(pdf["fold"], pdf["g"]):
                m = np.zeros((p, p))
                m[ri, ci] = flat
                m = m + np.triu(m, 1).T
                for name, keep in members.items():
                    a = m[np.ix_(keep, keep)].copy()
                    a[np.arange(1, len(keep)), np.arange(1, len(keep))] += alpha
                    beta = np.zeros(p - 1)
                    beta[keep] = np.linalg.lstsq(a, m[keep, p - 1], rcond=None)[0]
                    out.append((name, int(fold), beta.tolist()))
            yield pd.DataFrame(out, columns=["run", "fold", "beta"])

    return folds.mapInPandas(batch, "run string, fold bigint, beta array<double>")


def ridge_set_predictions(positioned: DataFrame, wf: WalkForward, sets: Mapping[str, Sequence[str]], y: str = "y",
                          alpha: float = 1.0) -> DataFrame:
    """Predictions of all sets: test rows against the few coefficient rows of their fold."""
    check_sets(positioned, sets)
    columns = _set_columns(sets)
    fits = ridge_set_fits(positioned, wf, sets, y, alpha)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    score = F.aggregate(F.zip_with("beta", x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
    # sets x folds coefficient rows: declared sets times calendar / step.
    test = assign_folds(positioned, wf, ("test",)).join(F.broadcast(fits), "fold")
    return test.select("run", "fold", "symbol", "ts", F.col(y).alias("y_true"), score.alias("y_pred"), "open", "volume", "beta", *columns)


def ridge_set_returns(positioned: DataFrame, wf: WalkForward, sets: Mapping[str, Sequence[str]], y: str = "y", alpha: float = 1.0,
                      costs: rep.Costs = rep.BACKTEST_COSTS) -> DataFrame:
    """``portfolio_returns`` of ``ridge_set_predictions``; the sets' signals stand side by side in a test row, so sets do not
    multiply what is moved and sorted."""
    check_sets(positioned, sets)
    columns = _set_columns(sets)
    daily = materialized(gram(positioned, ["pos", "n_days"], columns, y))
    beside = _set_fits(daily, wf, sets, alpha).groupBy("fold").agg(
        *[F.max(F.when(F.col("run") == name, F.col("beta"))).alias(f"_b{i}") for i, name in enumerate(sets)])
    # Folds and their coefficients are laid over dates, not over bars: a row per date of the calendar and fold it is tested in.
    dates = assign_folds(daily.select("pos", "n_days"), wf, ("test",)).join(F.broadcast(beside), "fold").drop("n_days", "role")
    test = positioned.join(F.broadcast(dates), "pos")
    signals = {f"_s{i}": rep.sign_signal(linear_score(columns, f"_b{i}")) for i in range(len(sets))}
    rows = test.select("fold", "symbol", "ts", "open", "volume", *[s.alias(c) for c, s in signals.items()])
    ret = rep.mean_returns(rows, ["fold"], dict(zip(sets, signals)), costs)
    return ret.withColumnRenamed("signal", "run")


def lift_over(metrics: DataFrame, reference: str, by: Sequence[str] = (), value: str = "sharpe") -> DataFrame:
    """Difference of each run to the reference run inside the same group."""
    base = F.max(F.when(F.col("run") == reference, F.col(value))).over(Window.partitionBy(*by))
    return metrics.withColumn("lift", F.col(value) - base).where(F.col("run") != reference)


def leave_one_out_attribution(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What each feature adds: metric with all minus metric without it, ranked."""
    from tidemark.operators.ranks import small_average_rank

    lifts = lift_over(metrics, "all", by).select(*by, F.regexp_replace("run", "^all-", "").alias("feature"), (-F.col("lift")).alias("importance"))
    return lifts.withColumn("rank", small_average_rank(F.col("importance"), *by, ascending=False))


def permuted_predictions(pred: DataFrame, columns: Sequence[str], features: Sequence[str], repeats: int, seed: int = 0) -> DataFrame:
    """Linear predictions with one column shuffled inside each (fold, symbol) test window.

    Every value gets two places in its window: one in time, one by a hash of (seed, feature,
    repeat, symbol, ts). Rows are shuffled once, into arrays of one window each (as many rows as a
    test window has bars); features and repeats are laid over these arrays, so what is moved and
    written does not grow with their number. Nothing is refitted.
    """
    others = [c for c in pred.columns if c not in ("fold", "symbol")]
    line = F.sort_array(F.collect_list(F.struct("ts", *[c for c in others if c != "ts"])))
    windows = pred.groupBy("fold", "symbol").agg(line.alias("_line"))
    draws = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(columns.index(f) + 2).alias("j")) for f in features])
    windows = windows.withColumn("_d", F.explode(draws)).select("*", "_d.feature", "_d.j").drop("_d")
    windows = windows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def value(cell: Column) -> Column:
        """The cell's value of the feature that is shuffled."""
        return F.coalesce(*[F.when(F.col("feature") == f, cell[f].cast("double")) for f in features])

    order = lambda c: uniform(F.lit(seed), F.col("feature"), F.col("repeat"), F.col("symbol"), F.unix_seconds(c["ts"]))
    drawn = F.array_sort(F.transform("_line", lambda c: F.struct(order(c).alias("u"), c["ts"].alias("ts"), value(c).alias("x"))))
    laid = F.zip_with("_line", drawn, lambda c, d: F.struct(c.alias("c"), (d["x"] - value(c)).alias("delta")))
    moved = windows.select("fold", "symbol", "feature", "repeat", "j", F.explode(laid).alias("_r"))
    score = F.col("_r.c.y_pred") + F.element_at("_r.c.beta", F.col("j")) * F.col("_r.delta")
    return moved.select(*[score.alias(c) if c == "y_pred" else F.col(f"_r.c.{c}") if c in others else F.col(c) for c in pred.columns], "feature", "repeat")


def sign_return(earned: str = "y_true") -> Column:
    """Mean of what the sign of each forecast earns, as an aggregate."""
    return F.avg(F.coalesce(F.signum("y_pred"), F.lit(0.0)) * F.col(earned))


def sign_returns(pred: DataFrame, by: Sequence[str] = ("run",), earned: str = "y_true") -> DataFrame:
    """Mean over symbols, per bar, of what the sign of each forecast earns; no costs, no shares."""
    return pred.groupBy(*by, "fold", "ts").agg(sign_return(earned).alias("ret"))


def permutation_importance(pred: DataFrame, columns: Sequence[str], features: Sequence[str], repeats: int = 10, seed: int = 0,
                           returns: Callable[[DataFrame, Sequence[str]], DataFrame] = portfolio_returns) -> DataFrame:
    """Mean and standard error over repeats of the Sharpe lost by shuffling a feature.

    ``returns`` turns predictions into a return per bar: a replay with costs, or ``sign_returns``.
    """
    sharpes = lambda df, by: returns(df, by).groupBy(*by, "fold").agg(met.sharpe("ret").alias("sharpe"))
    base = sharpes(pred, []).select("fold", F.col("sharpe").alias("_base"))
    per_fold = sharpes(permuted_predictions(pred, columns, features, repeats, seed), ["feature", "repeat"])
    loss = per_fold.join(base, "fold").groupBy("feature", "repeat").agg(F.avg(F.col("_base") - F.col("sharpe")).alias("loss"))
    return loss.groupBy("feature").agg(F.avg("loss").alias("importance"),
                                       (F.stddev_samp("loss") / F.sqrt(F.count("loss"))).alias("std_error"))


# --- label schemes --------------------------------------------------------------------------
@dataclass(frozen=True)
class LabelScheme:
    """A label as a callable that builds its column, and the bars it looks ahead."""

    label: Callable[[], Column]
    horizon: int


def label_ablation(features: DataFrame, schemes: Mapping[str, LabelScheme], columns: Sequence[str], wf: WalkForward,
                   earned: str = "earned", alpha: float = 1.0) -> DataFrame:
    """(run, fold, symbol, ts, y_true, y_pred, earned): one ridge model per label scheme.

    All labels stand beside the features in a bar's row, so schemes multiply nothing that is moved or written, and all
    schemes' cross products are one aggregation by date. Each scheme has its own complete rows, calendar and purge:
    its horizon comes with the label. ``earned`` is what a forecast of the bar is judged by. Features are read
    twice, for the cross products and for the forecasts, and labels are computed at each reading: pass a written table.
    """
    labels = {f"_y{i}": s.label().cast("double") for i, s in enumerate(schemes.values())}
    wide = features.withColumns(labels).select("symbol", "ts", earned, *columns, *labels)
    named = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    complete = {name: reduce(lambda a, c: a & c, [named(c).isNotNull() for c in (f"_y{i}", *columns)]) for i, name in enumerate(schemes)}
    parts = [gram_cells([*columns, f"_y{i}"], complete[name]) for i, name in enumerate(schemes)]
    # A row per date and scheme.
    sums = wide.groupBy("ts").agg(*[F.struct(F.lit(name).alias("run"), F.array(*cells).alias("g"), F.count_if(complete[name]).alias("n_rows")).alias(f"_s{i}")
                                    for i, (name, cells) in enumerate(zip(schemes, parts))])
    daily = sums.select("ts", F.explode(F.array(*[f"_s{i}" for i in range(len(schemes))])).alias("_s")).select("ts", "_s.*").where("n_rows > 0")
    per_run = Window.partitionBy("run")
    daily = materialized(daily.withColumns({
        "pos": (F.row_number().over(per_run.orderBy("ts")) - 1).cast("bigint"), "n_days": F.count(F.lit(1)).over(per_run)}).where("ts IS NOT NULL"))
    width = (len(columns) + 2) * (len(columns) + 3) // 2
    folds = reduce(DataFrame.unionByName, [assign_folds(daily.where(F.col("run") == name), replace(wf, horizon=scheme.horizon), ("train",))
                                           for name, scheme in schemes.items()])
    fits = solve(add_grams(folds, ["run", "fold"], width), ["run", "fold"], columns, alpha)
    # Folds and coefficients are laid over dates: a row per scheme, date and fold it is tested in.
    dates = assign_folds(daily.select("run", "ts", "pos", "n_days"), wf, ("test",)).join(F.broadcast(fits.select("run", "fold", "beta")), ["run", "fold"])
    test = wide.join(F.broadcast(dates.select("run", "fold", "ts", "beta")), "ts")
    mine = F.coalesce(*[F.when((F.col("run") == name) & complete[name], F.col(f"_y{i}")) for i, name in enumerate(schemes)])
    return test.select("run", "fold", "symbol", "ts", mine.alias("y_true"), linear_score(columns).alias("y_pred"), earned).where("y_true IS NOT NULL")


# --- A/B of feature builds ------------------------------------------------------------------
def build_ab(a: DataFrame, b: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Per column: share of changed cells and of sign flips between two builds."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
        return df.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) AS (feature, {name})"))

    j = tall(a, "_a").join(tall(b, "_b"), [*keys, "feature"])
    changed = ~F.col("_a").eqNullSafe(F.col("_b"))
    flip = F.coalesce(F.signum("_a") != F.signum("_b"), F.lit(False))
    return j.groupBy("feature").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(changed.cast("double")).alias("changed_share"),
                                    F.avg(flip.cast("double")).alias("sign_flip_share"))


def shift_match(a: DataFrame, b: DataFrame, columns: Sequence[str], key: Sequence[str] = (), order: str = "ts", most: int = 5) -> DataFrame:
    """Per column the lag k at which build ``a`` most often equals the other's value k rows before.

    (feature, best_lag, match_share, same_share): a build that is the other one shifted shows a
    lag over 0. One window pass counts equal values at every lag from 0 to ``most``; rows without
    a value on either side, or too early for the longest lag, are left out. Of equally good lags
    the smallest.
    """
    cells = ", ".join(f"'{c}', a.`{c}`, b.`{c}`" for c in columns)
    on = [*key, order]
    j = a.select(*on, *columns).alias("a").join(b.select(*on, *columns).alias("b"), on).select(
        *on, F.expr(f"stack({len(columns)}, {cells}) AS (feature, _a, _b)"))
    line = Window.partitionBy("feature", *key).orderBy(order)
    seen = j.withColumns({f"_l{k}": F.lag("_b", k).over(line) for k in range(most + 1)})
    whole = seen.where(" AND ".join(["_a IS NOT NULL", *[f"_l{k} IS NOT NULL" for k in range(most + 1)]]))
    shares = whole.groupBy("feature").agg(*[F.avg((F.col("_a") == F.col(f"_l{k}")).cast("double")).alias(f"_s{k}") for k in range(most + 1)])
    best = F.greatest(*[F.col(f"_s{k}") for k in range(most + 1)])
    lag = F.coalesce(*[F.when(F.col(f"_s{k}") == best, F.lit(k)) for k in range(most + 1)])
    return shares.select("feature", lag.alias("best_lag"), best.alias("match_share"), F.col("_s0").alias("same_share"))


def regime_delta(a: DataFrame, b: DataFrame, regime: str = "regime", ret: str = "ret") -> DataFrame:
    """Sharpe of the returns under either build, and their difference, per regime and over all."""
    both = a.select("ts", regime, ret, F.lit("a").alias("_build")).unionByName(b.select("ts", regime, ret, F.lit("b").alias("_build")))
    both = both.withColumn(regime, F.explode(F.array(F.col(regime), F.lit("aggregate"))))
    side = lambda name: met.sharpe(F.when(F.col("_build") == name, F.col(ret)))
    out = both.groupBy(regime).agg(side("a").alias("sharpe_a"), side("b").alias("sharpe_b"))
    return out.withColumn("delta", F.col("sharpe_a") - F.col("sharpe_b"))


def best_baseline(scores: DataFrame, by: Sequence[str], name: str = "run", value: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.max_by(name, value).alias("best"), F.max(value).alias(value))


def forecast_from_errors(labels: DataFrame, errors: DataFrame) -> DataFrame:
    """Mean forecast per bar recovered as mean label minus stored error."""
    mean_y = labels.groupBy("ts").agg(F.avg("y").alias("_y"))
    return errors.join(mean_y, "ts").withColumn("mean_forecast", F.col("_y") - F.col("err")).drop("_y")
