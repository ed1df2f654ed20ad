"""Regime tags on dated rows and market-condition axes."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as win
from tidemark.operators.timejoin import attach_macro

# Eras, both ends inclusive, and thresholds.
DEFAULT_ERAS = (("qe_bull", "2010-01-01", "2019-12-31"), ("covid", "2020-01-01", "2021-12-31"),
                ("rate_cycle", "2022-01-01", "2099-12-31"))
DEFAULT_LABEL = "pre_qe"
VOL_LOW, VOL_HIGH = 15.0, 25.0
RATES_WINDOW, RATES_BAND = 63, 0.25

Detector = Callable[[DataFrame], DataFrame]


def check_eras(ranges: Sequence[tuple[str, str, str]]) -> None:
    spans = sorted((dt.date.fromisoformat(a), dt.date.fromisoformat(b), n) for n, a, b in ranges)
    for start, end, name in spans:
        if start > end:
            raise ValueError(f"era {name} starts after it ends")
    for (_, end, a), (start, _, b) in zip(spans, spans[1:]):
        if start <= end:
            raise ValueError(f"eras {a} and {b} overlap")


def era(ts: Column | str = "ts", ranges: Sequence[tuple[str, str, str]] = DEFAULT_ERAS,
        default: str = DEFAULT_LABEL) -> Column:
    """Named date range of a row. Dates are compared, so the whole last day counts."""
    check_eras(ranges)
    day = F.to_date(ts)
    label = F.lit(default)
    for name, start, end in ranges:
        label = F.when(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), name).otherwise(label)
    return label


def era_detector(ranges=DEFAULT_ERAS, default: str = DEFAULT_LABEL, ts: str = "ts", out: str = "regime") -> Detector:
    return lambda df: df.withColumn(out, era(ts, ranges, default))


def vol_label(value: Column | str, low: float = VOL_LOW, high: float = VOL_HIGH) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    if low >= high:
        raise ValueError("low must be below high")
    return F.when(v <= low, "low_vol").when(v >= high, "high_vol").when(v.isNotNull(), "mid_vol")


def vol_detector(series: DataFrame, ts: str = "ts", out: str = "regime") -> Detector:
    """Exact-date lookup in a (day, value) table; a date without a value is an error row.

    The error surfaces when the row is read, so the plan stays lazy.
    """
    def tag(df: DataFrame) -> DataFrame:
        values = series.select(F.col("day").alias("_day"), F.col("value").alias("_v"))
        joined = df.join(values, F.to_date(ts) == F.col("_day"), "left")
        label = F.coalesce(vol_label("_v"), F.raise_error(F.concat(F.lit("no volatility value for "), F.col(ts).cast("string"))).cast("string"))
        return joined.withColumn(out, label).drop("_day", "_v")

    return tag


def tag(df: DataFrame, detector: Detector) -> DataFrame:
    return df.transform(detector)


def rates_label(change: Column | str, band: float = RATES_BAND) -> Column:
    c = F.col(change) if isinstance(change, str) else change
    return F.when(c > band, "rising").when(c < -band, "falling").when(c.isNotNull(), "flat")


def trend_label(price: str = "close", n: int = 200, *keys: str) -> Column:
    """Above or below the mean of the last ``n`` bars, on the full history."""
    mean = win.rolling_mean(price, n, *keys)
    return F.when(F.col(price) > mean, "uptrend").when(mean.isNotNull(), "downtrend")


def market_axes(days: DataFrame, macro: DataFrame, benchmark: DataFrame, start: str, end: str) -> DataFrame:
    """Tall (ts, axis, condition): volatility, rates and trend on the given days.

    Market series are carried forward onto the days; an axis without data adds no rows.
    """
    dated = attach_macro(days.select("ts").distinct(), macro, ["VIXCLS", "DGS10"], start, end)
    # One market-wide series: the window holds one row per calendar day.
    from pyspark.sql import Window

    line = Window.orderBy("ts")
    tagged = dated.select(
        "ts", vol_label("VIXCLS").alias("volatility"),
        rates_label(F.col("DGS10") - F.lag("DGS10", RATES_WINDOW).over(line)).alias("rates"))
    vol_rates = tagged.select("ts", F.expr("stack(2, 'volatility', volatility, 'rates', rates) AS (axis, condition)"))
    trend_days = benchmark.withColumn("condition", trend_label()).select("ts", "condition")
    marks = days.select("ts").distinct().withColumn("_want", F.lit(True)).join(trend_days, "ts", "full")
    trend = marks.select("ts", "_want", F.last("condition", ignorenulls=True).over(
        line.rowsBetween(Window.unboundedPreceding, 0)).alias("condition")).where("_want")
    trend = trend.select("ts", F.lit("trend").alias("axis"), "condition")
    return vol_rates.unionByName(trend).where("condition IS NOT NULL")
