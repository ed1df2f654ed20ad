"""Forecast models fitted per fold as Spark jobs.

Linear models need only sums: each date's sums are built once over all symbols,
folds add up the dates of their window, and a tiny system per fold is solved. The
raw panel is neither copied per fold nor gathered in a task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.splits import WalkForward, assign_folds
from tidemark.operators.stats import uniform
from tidemark.sources.lake import materialized


def inner_time_split(train_rows: DataFrame, wf: WalkForward, n_splits: int = 3) -> DataFrame:
    """Ordered splits inside each training window: block k+1 is tested, earlier blocks train.

    Works on the position within the fold, so rows of one date stay together.
    """
    width = (wf.train - wf.gap) // (n_splits + 1)
    ipos = F.col("pos") - wf.step * F.col("fold")
    block = F.floor(ipos / width)
    ks = F.sequence(F.lit(0), F.lit(n_splits - 1))
    cells = F.transform(
        F.filter(ks, lambda k: block <= k + 1),
        lambda k: F.struct(k.cast("bigint").alias("inner_fold"),
                           F.when(block == k + 1, "test").otherwise("train").alias("inner_role")))
    out = train_rows.withColumn("_c", F.explode(cells))
    return out.select(*train_rows.columns, "_c.inner_fold", "_c.inner_role")


# --- sums -----------------------------------------------------------------------------------
def _names(columns: Sequence[str]) -> list[str]:
    return ["_1", *columns, "_y"]


def gram(rows: DataFrame, by: Sequence[str], columns: Sequence[str], y: str = "y", weight: Column | None = None) -> DataFrame:
    """Upper triangle of the weighted cross-product matrix of (1, columns, y), as one array."""
    full = rows.withColumns({"_1": F.lit(1.0), "_y": F.col(y).cast("double"), "_w": F.lit(1.0) if weight is None else weight})
    cells = [F.sum(F.col("_w") * F.col(a) * F.col(b)) for a, b in combinations_with_replacement(_names(columns), 2)]
    return full.groupBy(*by).agg(F.array(*cells).alias("g"), F.count(F.lit(1)).alias("n_rows"))


def gram_cells(columns: Sequence[str], where: Column) -> list[Column]:
    """The cells of ``gram`` over the rows that fulfil ``where``; the last column is the target."""
    full = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    return [F.coalesce(F.sum(F.when(where, a * b)), F.lit(0.0)) for a, b in combinations_with_replacement(full, 2)]


def add_grams(grams: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    return grams.groupBy(*by).agg(F.array(*[F.sum(F.col("g")[i]) for i in range(width)]).alias("g"), F.sum("n_rows").alias("n_rows"))


def solve(grams: DataFrame, by: Sequence[str], columns: Sequence[str], alpha: float = 0.0) -> DataFrame:
    """Intercept and coefficients per group; the penalty spares the intercept."""
    p = len(columns) + 2
    rows_i, cols_i = np.triu_indices(p)

    def batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            beta = []
            for flat in pdf["g"]:
                m = np.zeros((p, p))
                m[rows_i, cols_i] = flat
                m = m + np.triu(m, 1).T
                a, b = m[:-1, :-1].copy(), m[:-1, -1]
                a[np.arange(1, p - 1), np.arange(1, p - 1)] += alpha
                beta.append(np.linalg.lstsq(a, b, rcond=None)[0].tolist())
            yield pdf[list(by) + ["n_rows"]].assign(beta=beta)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in grams.schema if f.name in by]
    return grams.select(*by, "n_rows", "g").mapInPandas(batch, ", ".join([*fields, "n_rows bigint", "beta array<double>"]))


def linear_score(columns: Sequence[str], beta: str = "beta") -> Column:
    out = F.col(beta)[0]
    for i, c in enumerate(columns):
        out = out + F.col(beta)[i + 1] * F.col(c)
    return out


def ridge_fits(positioned: DataFrame, wf: WalkForward, columns: Sequence[str], y: str = "y", alpha: float = 1.0,
               by: Sequence[str] = ()) -> DataFrame:
    """Ridge coefficients per (by, fold) from per-date sums."""
    width = (len(columns) + 2) * (len(columns) + 3) // 2
    daily = gram(positioned, [*by, "pos", "n_days"], columns, y)
    folds = assign_folds(daily, wf, ("train",))
    return solve(add_grams(folds, [*by, "fold"], width), [*by, "fold"], columns, alpha)


def ridge_predict(positioned: DataFrame, wf: WalkForward, columns: Sequence[str], y: str = "y", alpha: float = 1.0) -> DataFrame:
    """Out-of-sample predictions; one small row of coefficients per fold is joined."""
    fits = ridge_fits(positioned, wf, columns, y, alpha)
    test = assign_folds(positioned, wf, ("test",))
    # At most calendar / step folds: a few hundred rows, fixed by the calendar.
    return test.join(F.broadcast(fits.select("fold", "beta")), "fold").withColumn("y_pred", linear_score(columns)).drop("beta")


def mean_predict(positioned: DataFrame, wf: WalkForward, y: str = "y") -> DataFrame:
    """Training-window mean, from per-date sums."""
    daily = positioned.groupBy("pos", "n_days").agg(F.sum(y).alias("_s"), F.count(y).alias("_k"))
    means = assign_folds(daily, wf, ("train",)).groupBy("fold").agg((F.sum("_s") / F.sum("_k")).alias("y_pred"))
    return assign_folds(positioned, wf, ("test",)).join(F.broadcast(means), "fold")


# --- AR(1) ----------------------------------------------------------------------------------
def ar1_fits(train_rows: DataFrame, by: Sequence[str], y: str = "y", order: str = "ts") -> DataFrame:
    """Least-squares AR(1) per group: mean, phi and last value."""
    w = Window.partitionBy(*by).orderBy(order)
    pairs = train_rows.withColumn("_p", F.lag(y).over(w))
    both = F.col("_p").isNotNull()
    fit = pairs.groupBy(*by).agg(
        F.regr_slope(F.when(both, F.col(y)), F.col("_p")).alias("phi"),
        F.regr_intercept(F.when(both, F.col(y)), F.col("_p")).alias("_c"),
        F.max_by(y, order).alias("last_y"), F.avg(y).alias("_avg"), F.count(y).alias("n_train"))
    mu = F.coalesce(F.try_divide(F.col("_c"), 1 - F.col("phi")), F.col("_avg"))
    return fit.select(*by, F.coalesce("phi", F.lit(0.0)).alias("phi"), mu.alias("mu"), "last_y", "n_train")


def ar1_predict(positioned: DataFrame, wf: WalkForward, y: str = "y", key: str = "symbol") -> DataFrame:
    """Per-symbol multi-step forecasts mu + phi^k (y_T - mu) over each test window."""
    train = assign_folds(positioned, wf, ("train",))
    fits = ar1_fits(train, ["fold", key], y)
    test = assign_folds(positioned, wf, ("test",))
    k = F.row_number().over(Window.partitionBy("fold", key).orderBy("ts"))
    steps = test.withColumn("k", k).join(fits, ["fold", key])
    return steps.withColumn("y_pred", F.col("mu") + F.pow("phi", F.col("k")) * (F.col("last_y") - F.col("mu")))


def ar1_pooled_predict(positioned: DataFrame, wf: WalkForward, y: str = "y", key: str = "symbol") -> DataFrame:
    """Parity mode: the pool stacked by symbol is one series, forecast from its end.

    Lag pairs inside a symbol are windows; the seams between symbols come from one
    (first, last) row per symbol and fold.
    """
    train = assign_folds(positioned, wf, ("train",))
    w = Window.partitionBy("fold", key).orderBy("ts")
    inner = train.withColumn("_p", F.lag(y).over(w)).where("_p IS NOT NULL").select("fold", F.col(y).alias("_y"), "_p")
    ends = train.groupBy("fold", key).agg(F.min_by(y, "ts").alias("_first"), F.max_by(y, "ts").alias("_last"))
    # One row per symbol and fold is left: its neighbours in symbol order are a short window.
    seam = ends.withColumn("_p", F.lag("_last").over(Window.partitionBy("fold").orderBy(key)))
    seams = seam.where("_p IS NOT NULL").select("fold", F.col("_first").alias("_y"), "_p")
    tail = ends.groupBy("fold").agg(F.max_by("_last", key).alias("last_y"))
    fit = inner.unionByName(seams).groupBy("fold").agg(F.regr_slope("_y", "_p").alias("phi"), F.regr_intercept("_y", "_p").alias("_c"))
    fit = fit.join(tail, "fold").withColumn("mu", F.try_divide(F.col("_c"), 1 - F.col("phi")))
    test = assign_folds(positioned, wf, ("test",))
    k = F.row_number().over(Window.partitionBy("fold", key).orderBy("ts"))
    out = test.withColumn("k", k).join(F.broadcast(fit), "fold")
    return out.withColumn("y_pred", F.col("mu") + F.pow("phi", F.col("k")) * (F.col("last_y") - F.col("mu")))


def one_step_forecast(history: DataFrame, key: str = "symbol", y: str = "y", min_obs: int = 30) -> DataFrame:
    """Forecast from the end of each symbol's history, for symbols with enough labels."""
    fits = ar1_fits(history.where(F.col(y).isNotNull()), [key], y).where(F.col("n_train") >= min_obs)
    return fits.withColumn("forecast", F.col("mu") + F.col("phi") * (F.col("last_y") - F.col("mu")))


def expanding_ar1_signal(bars: DataFrame, refit: int = 63, min_obs: int = 252) -> DataFrame:
    """Sign of an expanding-window AR(1) one-step forecast, refitted every ``refit`` bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = bars.withColumn("_r", F.try_divide("close", F.lag("close").over(w)) - 1).where("_r IS NOT NULL")
    r = r.withColumn("_p", F.lag("_r").over(w)).withColumn("_n", F.row_number().over(w))
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    phi, c = F.regr_slope("_r", "_p").over(seen), F.regr_intercept("_r", "_p").over(seen)
    due = (F.col("_n") >= min_obs) & ((F.col("_n") - min_obs) % refit == 0)
    fc = F.when(due, F.coalesce(F.signum(c + phi * F.col("_r")), F.lit(0.0)))
    out = r.withColumn("_s", fc).withColumn("signal", F.coalesce(F.last("_s", ignorenulls=True).over(seen), F.lit(0.0)).cast("int"))
    return out.drop("_r", "_p", "_n", "_s")


def latest_row_scores(rows: DataFrame, columns: Sequence[str], y: str = "y", key: str = "symbol", min_obs: int = 30,
                      alpha: float = 1.0) -> DataFrame:
    """Fit each symbol on its complete labelled rows and score its last complete row."""
    complete = rows.dropna(subset=list(columns))
    fits = solve(gram(complete.where(F.col(y).isNotNull()), [key], columns, y), [key], columns, alpha).where(
        F.col("n_rows") >= min_obs)
    last = complete.groupBy(key).agg(F.max_by(F.struct("ts", *columns), "ts").alias("_r")).select(key, "_r.*")
    return last.join(fits, key).select(key, "ts", linear_score(columns).alias("forecast"), "n_rows")


# --- Spark ML per fold ----------------------------------------------------------------------
def fold_ids(positioned: DataFrame, wf: WalkForward) -> list[int]:
    """Numbers of the folds the calendar holds; each is then fitted by a distributed job."""
    n = positioned.agg(F.max("n_days")).first()[0] or 0
    return list(range(max(0, (n - wf.test - wf.train) // wf.step + 1))) if wf.train > wf.gap else []


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df)


# The search space of the boosted-tree arm.
SEARCH_SPACE = {"maxDepth": (3, 4, 5, 6), "stepSize": (0.01, 0.05, 0.1, 0.2), "maxIter": (50, 100, 200),
                "subsamplingRate": (0.6, 0.8, 1.0)}


def random_search(n: int, seed: int, space=SEARCH_SPACE) -> list[dict]:
    import random

    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in space.items()} for _ in range(n)]


def boosted_trees(columns: Sequence[str], y: str = "y", weight: str | None = None, seed: int = 0, **params):
    from pyspark.ml.regression import GBTRegressor

    est = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="y_pred", seed=seed, **params)
    return est.setWeightCol(weight) if weight else est


def boosted_tree_predict(positioned: DataFrame, wf: WalkForward, columns: Sequence[str], y: str = "y",
                         weight: str | None = None, draws: Sequence[dict] = ({},), n_splits: int = 3, seed: int = 0) -> DataFrame:
    """Boosted trees per fold; several draws are compared by MSE on inner time splits."""
    from pyspark.ml.evaluation import RegressionEvaluator

    rows = assembled(assign_folds(positioned, wf), columns)
    mse = RegressionEvaluator(labelCol=y, predictionCol="y_pred", metricName="mse")
    out = None
    for fold in fold_ids(positioned, wf):
        own = rows.where(F.col("fold") == fold)
        train = own.where("role = 'train'").persist()
        best = draws[0]
        if len(draws) > 1:
            inner = inner_time_split(train, wf, n_splits)
            scores = []
            for d in draws:
                est = boosted_trees(columns, y, weight, seed, **d)
                total = 0.0
                for k in range(n_splits):
                    part = inner.where(F.col("inner_fold") == k)
                    total += mse.evaluate(est.fit(part.where("inner_role = 'train'")).transform(part.where("inner_role = 'test'")))
                scores.append(total / n_splits)
            best = draws[int(np.argmin(scores))]
        model = boosted_trees(columns, y, weight, seed, **best).fit(train)
        train.unpersist()
        pred = model.transform(own.where("role = 'test'")).drop("_x")
        out = pred if out is None else out.unionByName(pred)
    return out


#: Rows of a task that fits trees.
TREE_ROWS = 100_000


def gain_importance(rows: DataFrame, columns: Sequence[str], y: str = "y", seed: int = 0, **params) -> DataFrame:
    """In-sample split-gain importance as (feature, importance).

    The learner reads its rows, and what it keeps of them, again in every step: they are dealt over so many
    tasks that one of them has about ``TREE_ROWS``, however many there are.
    """
    used = materialized(rows.dropna(subset=[*columns, y]).select(*columns, y))
    dealt = used.repartition(max(1, -(-used.count() // TREE_ROWS)))
    model = boosted_trees(columns, y, None, seed, **params).fit(assembled(dealt, columns))
    pairs = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return rows.sparkSession.createDataFrame(pairs, "feature string, importance double")


def logistic_fits(rows: DataFrame, by: Sequence[str], columns: Sequence[str], positive: Column, alpha: float = 1e-3,
                  most: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """Logistic coefficients of every group at once, by reweighted least squares.

    A step is one weighted cross-product pass over all groups and a tiny system per group; the
    coefficients, one row per group, are all that a step hands on. Steps end when no coefficient
    of any group moves any more, or after ``most`` of them: classes that can be separated keep
    moving slowly against the penalty ``alpha``, which spares the intercept.
    """
    by = list(by)
    data = materialized(rows.select(*by, *columns, positive.cast("double").alias("_lab")))
    beta = materialized(data.select(*by).distinct().withColumn("beta", F.array(*[F.lit(0.0)] * (len(columns) + 1))))
    for _ in range(most):
        # One row per group: folds of a calendar.
        seen = data.join(F.broadcast(beta), by).withColumn("_eta", linear_score(columns))
        p = 1 / (1 + F.exp(-F.col("_eta")))
        w = F.greatest(p * (1 - p), F.lit(1e-12))
        step = solve(gram(seen.withColumns({"_w0": w, "_z": F.col("_eta") + (F.col("_lab") - p) / w}), by, columns, "_z", F.col("_w0")), by, columns, alpha)
        new = materialized(step.select(*by, "beta"))
        old = beta.withColumnRenamed("beta", "_old")
        moved = new.join(old, by).agg(F.max(F.array_max(F.zip_with("beta", "_old", lambda x, y: F.abs(x - y)))).alias("d")).first().d
        beta = new
        if moved is None or moved <= tolerance:
            break
    return beta


def logistic_predict(positioned: DataFrame, wf: WalkForward, columns: Sequence[str], y: str = "y", alpha: float = 1e-3) -> DataFrame:
    """Probability that the label is positive; all folds are fitted together."""
    fits = logistic_fits(assign_folds(positioned, wf, ("train",)), ["fold"], columns, F.col(y) > 0, alpha)
    test = assign_folds(positioned, wf, ("test",)).join(F.broadcast(fits), "fold")
    return test.withColumn("y_pred", 1 / (1 + F.exp(-linear_score(columns)))).drop("beta")


def random_predict(positioned: DataFrame, wf: WalkForward, seed: int = 0) -> DataFrame:
    """A model without skill: forecasts in [-0.5, 0.5) that follow from a hash of (seed, symbol, instant)."""
    u = uniform(F.lit(seed), F.col("symbol"), F.unix_seconds("ts"))
    return assign_folds(positioned, wf, ("test",)).withColumn("y_pred", u - 0.5)


# --- document scoring -----------------------------------------------------------------------
# A small polarity word list used when no scoring model is plugged in.
POSITIVE = ("gain", "growth", "beat", "strong", "upgrade", "profit", "record", "improve", "win")
NEGATIVE = ("loss", "miss", "weak", "downgrade", "decline", "risk", "lawsuit", "cut", "fall", "error")


def lexicon_scores(docs: DataFrame, text: str = "text", positive: Sequence[str] = POSITIVE,
                   negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """Class shares of the words of the whole text, in built-in functions."""
    words = F.split(F.lower(text), r"[^a-z]+")
    n = F.greatest(F.size(F.filter(words, lambda w: F.length(w) > 0)), F.lit(1))
    pos = F.size(F.filter(words, lambda w: w.isin(*positive))) / n
    neg = F.size(F.filter(words, lambda w: w.isin(*negative))) / n
    return docs.withColumns({"sentiment_positive": pos, "sentiment_negative": neg, "sentiment_neutral": 1 - pos - neg,
                             "sentiment_score": pos - neg})


def score_documents(docs: DataFrame, make_scorer: Callable[[], Callable[[list[str]], Sequence[tuple[float, float, float]]]],
                    model_name: str, model_version: str, key: str = "document_id", text: str = "text") -> DataFrame:
    """Plug-in scorer, built once per task and fed Arrow batches of whole texts."""
    kind = docs.schema[key].dataType.simpleString()

    def batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in it:
            probs = np.asarray(scorer(pdf[text].fillna("").tolist()), dtype=float).reshape(-1, 3)
            yield pd.DataFrame({key: pdf[key], "sentiment_positive": probs[:, 0], "sentiment_negative": probs[:, 1],
                                "sentiment_neutral": probs[:, 2], "sentiment_score": probs[:, 0] - probs[:, 1]})

    scored = docs.select(key, text).mapInPandas(
        batch, f"{key} {kind}, sentiment_positive double, sentiment_negative double, sentiment_neutral double, sentiment_score double")
    return scored.withColumns({"model_name": F.lit(model_name), "model_version": F.lit(model_version)})


def unscored(docs: DataFrame, scored: DataFrame, key: str = "document_id") -> DataFrame:
    return docs.join(scored.select(key), key, "left_anti")
