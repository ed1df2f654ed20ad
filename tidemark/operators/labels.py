"""Forward-looking labels, tall: (symbol, ts, label_id, horizon_bars, y).

The horizon travels with the label, so that purging can only use the right one.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as win

# Target horizons and barrier parameters.
TARGETS = {"drawdown_21d": 21, "realized_vol_21d": 21, "directional_5d": 5, "directional_21d": 21}
ARMS = {"signed_return": 5, "vol_scaled": 5, "triple_barrier": 5}
DRAWDOWN_DEPTH = 0.05
BARRIER_UP, BARRIER_DOWN, BARRIER_BARS, VOL_WINDOW = 2.0, 1.0, 5, 21


def forward_return(h: int) -> Column:
    return F.try_divide(win.forward("close", h), F.col("close")) - 1


def direction(h: int) -> Column:
    return (forward_return(h) > 0).cast("double")


def vol_scaled_return(h: int, vol: Column | str = "_vol") -> Column:
    return F.try_divide(forward_return(h), F.col(vol) if isinstance(vol, str) else vol)


def log_realized_vol(h: int, ret: str = "_ret") -> Column:
    return F.ln(F.nullif(win.forward_std(ret, h), F.lit(0.0)))


def drawdown_event(h: int = 21, depth: float = DRAWDOWN_DEPTH) -> Column:
    """1 if the path p[t..t+h] ever falls by ``depth`` from its running peak."""
    path = F.collect_list("close").over(win.per("symbol").rowsBetween(0, h))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, p: Column) -> Column:
        peak = F.greatest(acc["peak"], p)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], p / peak - 1).alias("worst"))

    worst = F.aggregate(path, start, step, lambda acc: acc["worst"])
    return F.when(F.size(path) == h + 1, (worst <= -depth).cast("double"))


def triple_barrier(vol: str = "_vol", up: float = BARRIER_UP, down: float = BARRIER_DOWN,
                   bars: int = BARRIER_BARS) -> Column:
    """+1 / -1 for the first close beyond a volatility-scaled barrier, else 0."""
    path = F.array(*[win.forward("close", k) for k in range(1, bars + 1)])
    p, s = F.col("close"), F.col(vol)
    hit_up = F.array_position(F.transform(path, lambda x: x >= p * (1 + up * s)), True)
    hit_down = F.array_position(F.transform(path, lambda x: x <= p * (1 - down * s)), True)
    label = (F.when((hit_up == 0) & (hit_down == 0), 0.0).when(hit_up == hit_down, 0.0)
             .when((hit_up > 0) & ((hit_down == 0) | (hit_up < hit_down)), 1.0).otherwise(-1.0))
    return F.when((s > 0) & win.forward("close", bars).isNotNull(), label)


def _prepared(bars: DataFrame, vol_window: int = VOL_WINDOW) -> DataFrame:
    base = bars.withColumn("_ret", win.pct_change("close", 1))
    return base.withColumn("_vol", win.rolling_std("_ret", vol_window))


def _tall(wide: DataFrame, horizons: dict[str, int]) -> DataFrame:
    pairs = ", ".join(f"'{k}', {h}, {k}" for k, h in horizons.items())
    return wide.select("symbol", "ts", F.expr(f"stack({len(horizons)}, {pairs}) AS (label_id, horizon_bars, y)"))


def target_labels(bars: DataFrame, targets: Sequence[str] = tuple(TARGETS),
                  depth: float = DRAWDOWN_DEPTH) -> DataFrame:
    """All targets in one pass over the bars."""
    unknown = set(targets) - set(TARGETS)
    if unknown:
        raise KeyError(f"unknown targets {sorted(unknown)}; known: {sorted(TARGETS)}")
    cols = {
        "drawdown_21d": lambda: drawdown_event(TARGETS["drawdown_21d"], depth),
        "realized_vol_21d": lambda: log_realized_vol(TARGETS["realized_vol_21d"]),
        "directional_5d": lambda: direction(TARGETS["directional_5d"]),
        "directional_21d": lambda: direction(TARGETS["directional_21d"]),
    }
    wide = _prepared(bars).withColumns({t: cols[t]() for t in targets})
    return _tall(wide, {t: TARGETS[t] for t in targets})


def arm_labels(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Signed, volatility-scaled and triple-barrier labels with one shared horizon."""
    wide = _prepared(bars).withColumns({
        "signed_return": forward_return(horizon), "vol_scaled": vol_scaled_return(horizon),
        "triple_barrier": triple_barrier(bars=horizon)})
    return _tall(wide, {a: horizon for a in ARMS})


def horizons_agree(labels: DataFrame) -> DataFrame:
    """One row: whether every label carries the same horizon."""
    return labels.agg(F.countDistinct("horizon_bars").alias("n_horizons")).withColumn(
        "uniform", F.col("n_horizons") == 1)


def next_open_sign() -> Column:
    """Sign of the log return between the next two closes."""
    return F.signum(F.ln(F.try_divide(win.forward("close", 2), win.forward("close", 1))))


def uniqueness_weight(pos: Column, n: Column, horizon: int) -> Column:
    """Mean over the label's bars of 1 / (labels alive at that bar), not yet normalised."""
    alive = lambda b: F.greatest(F.lit(1), F.least(b - 1, n - 1) - F.greatest(F.lit(0), b - horizon) + 1)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.lit(0.0), lambda acc, j: acc + 1 / alive(pos + j))
    return total / horizon


def sample_weights(rows: DataFrame, horizon: int, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Uniqueness weights with mean 1 per key, for overlapping forward labels."""
    from pyspark.sql import Window

    group = Window.partitionBy(key)
    raw = rows.withColumn("_pos", (F.row_number().over(win.per(key, order=order)) - 1)).withColumn(
        "_n", F.count(F.lit(1)).over(group).cast("int"))
    raw = raw.withColumn("_w", uniqueness_weight(F.col("_pos"), F.col("_n"), horizon))
    return raw.withColumn("weight", F.col("_w") / F.avg("_w").over(group)).drop("_pos", "_n", "_w")
