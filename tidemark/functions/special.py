"""Distribution functions that Spark lacks, as Arrow-batched column functions.

They are applied after aggregation (one value per group), never on raw rows.
"""
from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EULER_GAMMA = 0.5772156649015329  # fixed value: Euler-Mascheroni constant
_STANDARD = NormalDist()


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def student_t_cdf(t: float, df: float) -> float:
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def _map(series: pd.Series, fn) -> pd.Series:
    return pd.Series([None if pd.isna(v) else fn(float(v)) for v in series], dtype="float64")


@F.pandas_udf(DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return _map(x, lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return _map(p, lambda v: _STANDARD.inv_cdf(v) if 0.0 < v < 1.0 else (math.inf if v >= 1 else -math.inf))


@F.pandas_udf(DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    out = [None if pd.isna(a) or pd.isna(b) else student_t_cdf(float(a), float(b)) for a, b in zip(t, df)]
    return pd.Series(out, dtype="float64")


def expected_max_sharpe(n_trials: Column, sharpe_std: Column) -> Column:
    """Expected best Sharpe of N skill-less trials; 0 when there was one trial."""
    n = n_trials.cast("double")
    safe = F.greatest(n, F.lit(2.0))
    z1 = norm_ppf(1 - 1 / safe)
    z2 = norm_ppf(1 - 1 / (safe * F.lit(math.e)))
    value = sharpe_std * ((1 - EULER_GAMMA) * z1 + EULER_GAMMA * z2)
    return F.when(n <= 1, F.lit(0.0)).otherwise(value)


def drawdown_probability(log_vol: Column, depth: float, horizon: int) -> Column:
    """Chance that a driftless walk of this log volatility falls by ``depth``."""
    z = -F.lit(depth) / (F.exp(log_vol) * math.sqrt(horizon))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * norm_cdf(z)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation aggregate; NULL instead of an error when a side is constant."""
    a, b = (F.when(a.isNotNull() & b.isNotNull(), v) for v in (a, b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def joined_correlation(keep: Column) -> Column:
    """Pearson correlation aggregate over the kept parts of a sample, each given by its moments
    (n, mx, my, vx, vy, cxy); NULL when a side is constant."""
    parts = F.collect_list(F.when(keep & (F.col("n") > 0), F.struct("n", "mx", "my", "vx", "vy", "cxy")))
    total = lambda part: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["n"] * part(p))
    n = total(lambda p: F.lit(1.0))
    mx, my = (F.try_divide(total(lambda p, m=m: p[m]), n) for m in ("mx", "my"))
    vx = total(lambda p: p["vx"] + (p["mx"] - mx) * (p["mx"] - mx))
    vy = total(lambda p: p["vy"] + (p["my"] - my) * (p["my"] - my))
    cxy = total(lambda p: p["cxy"] + (p["mx"] - mx) * (p["my"] - my))
    return F.try_divide(cxy, F.sqrt(vx) * F.sqrt(vy))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def tidy(x: Column, digits: int = 6) -> Column:
    """Half-even rounding for export: non-finite to NULL, -0.0 to 0.0."""
    return F.bround(finite(x), digits) + F.lit(0.0)
