"""Performance metrics as grouped aggregates over return series."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import ANNUAL


def sharpe(ret: Column | str = "ret", ann: int = ANNUAL) -> Column:
    r = F.col(ret) if isinstance(ret, str) else ret
    std = F.stddev_samp(r)
    return F.when(std > 0, F.avg(r) / F.nullif(std, F.lit(0.0)) * math.sqrt(ann)).otherwise(0.0)


def sortino(ret: Column | str = "ret", ann: int = ANNUAL) -> Column:
    r = F.col(ret) if isinstance(ret, str) else ret
    down = F.sqrt(F.avg(F.when(r < 0, r * r)))
    return F.when(down > 0, F.avg(r) / F.nullif(down, F.lit(0.0)) * math.sqrt(ann)).otherwise(0.0)


def total_return(ret: Column | str = "ret") -> Column:
    """Compounded by a true product, which stays right when some 1 + r <= 0."""
    r = F.col(ret) if isinstance(ret, str) else ret
    return F.product(1 + r) - 1


def with_drawdown(returns: DataFrame, by: Sequence[str], ts: str = "ts", ret: str = "ret") -> DataFrame:
    """Adds equity and drawdown; the peak starts at the first equity value."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    eq = returns.withColumn("equity", F.product(1 + F.col(ret)).over(w))
    peak = F.max("equity").over(w)
    return eq.withColumn("drawdown", F.try_divide(F.col("equity") - peak, peak))


def return_metrics(returns: DataFrame, by: Sequence[str], ts: str = "ts", ret: str = "ret",
                   ann: int = ANNUAL) -> DataFrame:
    """One row of metrics per group; NULL returns are left out."""
    by = list(by)
    dd = with_drawdown(returns.where(F.col(ret).isNotNull()), by, ts, ret)
    agg = dd.groupBy(*by).agg(
        F.count(ret).alias("n_bars"), total_return(ret).alias("total_return"), sharpe(ret, ann).alias("sharpe"),
        sortino(ret, ann).alias("sortino"), F.min("drawdown").alias("max_drawdown"))
    end = 1 + F.col("total_return")
    annual = F.when(end > 0, F.pow(end, F.lit(float(ann)) / F.col("n_bars")) - 1).otherwise(-1.0)
    out = agg.withColumn("annualized_return", annual)
    return out.withColumn("calmar", F.when(
        F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs(F.nullif("max_drawdown", F.lit(0.0)))))


def trade_metrics(trades: DataFrame, by: Sequence[str], pnl: str = "net_pnl") -> DataFrame:
    p = F.col(pnl)
    wins, losses = F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, p))
    return trades.groupBy(*by).agg(
        F.count(pnl).alias("n_trades"), F.avg((p > 0).cast("double")).alias("hit_rate"),
        F.when(losses.isNotNull(), F.coalesce(wins, F.lit(0.0)) / F.abs(F.nullif(losses, F.lit(0.0))))
        .otherwise(F.lit(float("inf"))).alias("profit_factor"))


def metrics(returns: DataFrame, by: Sequence[str], trades: DataFrame | None = None) -> DataFrame:
    """The whole set in one call. Groups without trades: hit rate 0, profit factor NULL."""
    out = return_metrics(returns, by)
    if trades is None:
        return out.withColumns({"hit_rate": F.lit(0.0), "profit_factor": F.lit(None).cast("double")})
    joined = out.join(trade_metrics(trades, by), list(by), "left")
    return joined.withColumn("hit_rate", F.coalesce("hit_rate", F.lit(0.0))).withColumn(
        "n_trades", F.coalesce("n_trades", F.lit(0)))


def regime_metrics(returns: DataFrame, by: Sequence[str], regime: str = "regime") -> DataFrame:
    """Per regime plus ``aggregate``; drawdown runs over the regime's own bars."""
    both = returns.withColumn(regime, F.explode(F.array(F.col(regime), F.lit("aggregate"))))
    return return_metrics(both, [*by, regime])


def forecast_errors(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    err = F.col("y_true") - F.col("y_pred")
    ok = pred.where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    return ok.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("n"))
