"""Per-symbol window columns: gated rolling frames, lags, fills, islands.

A symbol's rows are daily bars, at most one per calendar day, so a window
partition is bounded by the calendar and not by the amount of raw data.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

ANNUAL = 252  # fixed value: trading days per year


def per(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    return per(*keys, order=order).rowsBetween(-(n - 1), 0)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(agg: Column, x: Column | str, frame: WindowSpec, n: int) -> Column:
    """An aggregate over a frame, only when all ``n`` values are present."""
    return F.when(F.count(_c(x)).over(frame) == n, agg.over(frame))


def rolling_mean(x, n: int, *keys: str, order: str = "ts") -> Column:
    return full(F.avg(_c(x)), x, trailing(n, *keys, order=order), n)


def rolling_sum(x, n: int, *keys: str, order: str = "ts") -> Column:
    return full(F.sum(_c(x)), x, trailing(n, *keys, order=order), n)


def rolling_std(x, n: int, *keys: str, order: str = "ts") -> Column:
    return full(F.stddev_samp(_c(x)), x, trailing(n, *keys, order=order), n)


def whole_groups(batches: Iterator[pa.RecordBatch], chunk: int, weigh: Callable[[pa.RecordBatch], int] = len) -> Iterator[pa.Table]:
    """Batches of sorted rows as tables of whole groups, ``chunk`` rows and the rest of a group each.

    The column ``last`` marks the last row of a group.
    """
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += weigh(b)
        if n < chunk:
            continue
        table = pa.Table.from_batches(held)
        ends = np.flatnonzero(table["last"].combine_chunks().to_numpy(zero_copy_only=False))
        if len(ends):
            yield table.slice(0, int(ends[-1]) + 1)
            held, n = table.slice(int(ends[-1]) + 1).to_batches(), 0
    if held:
        yield pa.Table.from_batches(held)


#: Rows that one step of a task works on, at least one whole group.
CHUNK = 100_000


def _back(x: np.ndarray, j: int) -> np.ndarray:
    """Values ``j`` rows back; rows of the group before are masked by the caller."""
    return x if j == 0 else np.concatenate([np.full(min(j, len(x)), np.nan), x[:-j]])


def _moving_sum(x: np.ndarray, n: int) -> np.ndarray:
    k = _step(n)
    short = sum(_back(x, j) for j in range(k - 1, -1, -1))
    return sum(_back(short, j) for j in range(0, n, k))


def _moving_std(x: np.ndarray, n: int) -> np.ndarray:
    k = _step(n)
    mean = sum(_back(x, j) for j in range(k - 1, -1, -1)) / k
    avg, m2 = np.zeros(len(x)), np.zeros(len(x))
    for i, j in enumerate(range(k - 1, -1, -1), 1):
        delta = _back(x, j) - avg
        avg = avg + delta / i
        m2 = m2 + delta * (delta - delta / i)
    inside = sum(_back(m2 / k, j) for j in range(0, n, k))
    means = [_back(mean, j) for j in range(0, n, k)]
    # Around the first mean, so that equal values have no spread at all.
    whole = means[0] + sum(m - means[0] for m in means[1:]) / (n // k)
    return np.sqrt((inside + sum((m - whole) ** 2 for m in means)) * k / (n - 1))


def in_blocks(df: DataFrame, sums: Mapping[str, tuple[Column | str, Sequence[int]]], spreads: Mapping[str, Sequence[int]],
              *keys: str, order: str = "ts") -> DataFrame:
    """Adds ``_sum_<name>_<n>`` for every length of ``sums`` (name: values, lengths) and ``_std_<column>_<n>`` for
    every length of ``spreads``, both NULL unless all ``n`` values are present.

    A frame of n rows is read again for every row. Here only a short frame is, and a long one is put
    together from the results some rows back: n = step * k takes k of them. Nothing is subtracted, so
    nothing cancels: spreads are those inside the short frames and of their means around the whole mean.
    Spark shuffles and sorts the rows; a task takes each frame over the columns of a chunk of whole groups.
    """
    w = per(*keys, order=order)
    # A column of doubles is handed to the task once, as it is.
    own = {f.name for f in df.schema if f.dataType == T.DoubleType()}
    source = lambda name, x: x if isinstance(x, str) and x in own else f"_x_{name}"
    read = [(name, x) for name, (x, _) in sums.items()] + [(f"_{c}", c) for c in spreads]
    values = {source(name, x): _c(x).cast("double") for name, x in read if source(name, x) not in own}
    wanted = [(f"_sum_{name}_{n}", source(name, x), n, _moving_sum) for name, (x, lengths) in sums.items() for n in lengths]
    wanted += [(f"_std_{c}_{n}", source(f"_{c}", c), n, _moving_std) for c, lengths in spreads.items() for n in lengths]
    kept = df.columns
    # The window has put a group's rows into one task, in this order already.
    rows = df.withColumns(values | {"last": F.lead(order).over(w).isNull()}).sortWithinPartitions(*(keys or ("symbol",)), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CHUNK):
            ends = np.flatnonzero(table["last"].combine_chunks().to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            place = np.arange(table.num_rows) - np.repeat(starts, ends - starts)
            out = {c: table[c].combine_chunks() for c in kept}
            with np.errstate(all="ignore"):
                for name, x, n, frame in wanted:
                    moved = frame(table[x].combine_chunks().to_numpy(zero_copy_only=False), n)
                    out[name] = pa.array(np.where(place >= n - 1, moved, np.nan), from_pandas=True)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(w_[0], T.DoubleType()) for w_ in wanted]]))


def _step(n: int) -> int:
    """The divisor of ``n`` nearest to its root: the length of the short frame."""
    return min((k for k in range(1, n + 1) if n % k == 0), key=lambda k: (abs(k - math.sqrt(n)), k))


def pct_change(x, k: int, *keys: str, order: str = "ts") -> Column:
    return F.try_divide(_c(x), F.lag(_c(x), k).over(per(*keys, order=order))) - 1


def forward(x, k: int, *keys: str, order: str = "ts") -> Column:
    return F.lead(_c(x), k).over(per(*keys, order=order))


def forward_std(x, h: int, *keys: str, order: str = "ts") -> Column:
    return full(F.stddev_samp(_c(x)), x, per(*keys, order=order).rowsBetween(1, h), h)


def ffill(x, *keys: str, order: str = "ts") -> Column:
    return F.last(_c(x), ignorenulls=True).over(per(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0))


def running_max(x, *keys: str, order: str = "ts") -> Column:
    return F.max(_c(x)).over(per(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0))


def compounded(ret, *keys: str, order: str = "ts") -> Column:
    """Cumulative product of 1 + r; a true product, so it survives r <= -1."""
    return F.product(1 + _c(ret)).over(per(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0))


def rolling_sharpe(ret, n: int = 63, *keys: str, order: str = "ts") -> Column:
    mean, std = rolling_mean(ret, n, *keys, order=order), rolling_std(ret, n, *keys, order=order)
    return F.try_divide(mean, std) * math.sqrt(ANNUAL)


def island(x, *keys: str, order: str = "ts") -> Column:
    """Number of the run of equal values a row belongs to, from 0."""
    w = per(*keys, order=order)
    changed = F.when(F.lag(_c(x)).over(w).isNotNull() & (_c(x) != F.lag(_c(x)).over(w)), 1).otherwise(0)
    return changed


def with_islands(df: DataFrame, x: str, *keys: str, order: str = "ts") -> DataFrame:
    keys = keys or ("symbol",)
    flagged = df.withColumn("_chg", island(x, *keys, order=order))
    w = per(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("island", F.sum("_chg").over(w)).drop("_chg")


def ewma_log_vol(bars: DataFrame, lam: float = 0.94, block: int = 256) -> DataFrame:
    """Log volatility of the exponentially weighted variance (recursive form), over all history.

    v[0] = r[0]^2, v[t] = lam v[t-1] + (1-lam) r[t]^2 is a prefix sum of terms scaled by
    powers of lam. Scaling restarts in every block of returns, so it stays in range; a
    block's end value is carried into the next ones with weights lam^(block k), which are
    exactly zero in double precision once lam^(block k) underflows: so many blocks are read.
    """
    w = per("symbol")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    base = bars.withColumn("_r2", F.pow(pct_change("close", 1), 2))
    base = base.withColumn("_i", F.count("_r2").over(upto))  # returns so far; a gap keeps the last value
    place = F.greatest(F.col("_i") - 1, F.lit(0))
    base = base.withColumns({"_b": F.floor(place / block), "_j": F.pmod(place, F.lit(block))})
    term = F.when(F.col("_i") == 1, F.col("_r2")).otherwise(F.col("_r2") * (1 - lam)) * F.pow(F.lit(lam), -F.col("_j"))
    base = base.withColumn("_term", term)
    reach = int(np.ceil(np.log(np.nextafter(0, 1)) / np.log(lam) / block)) + 1
    earlier = Window.partitionBy("symbol").orderBy("_b").rowsBetween(-reach, -1)
    ends = base.groupBy("symbol", "_b").agg((F.sum("_term") * lam ** (block - 1)).alias("_end"))
    ends = ends.withColumn("_ends", F.collect_list("_end").over(earlier)).select(
        "symbol", "_b", F.aggregate("_ends", F.lit(0.0), lambda acc, x: acc * (lam ** block) + x).alias("_carry"))
    local = F.sum("_term").over(per("symbol", "_b").rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(lam), F.col("_j"))
    out = base.withColumn("_local", local).join(ends, ["symbol", "_b"])
    var = F.coalesce("_local", F.lit(0.0)) + F.col("_carry") * F.pow(F.lit(lam), F.col("_j") + 1)
    kept = [F.col(c) for c in bars.columns]
    return out.select(*kept, F.when(F.col("_i") > 0, F.ln(F.sqrt(var))).alias("ewma_log_vol"))


def latest_rows(df: DataFrame, key: str, k: int = 1, order: str = "ts") -> DataFrame:
    """Last ``k`` rows per key; Spark prunes with a group limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def downsample(df: DataFrame, n: int, *keys: str, order: str = "ts") -> DataFrame:
    """``n`` evenly spaced rows per series, both ends kept, half-even positions."""
    keys = keys or ("run",)
    w = per(*keys, order=order)
    sized = df.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    step = F.when(F.lit(n) > 1, (F.col("_n") - 1) / F.lit(float(max(n - 1, 1))))
    j = F.round(F.col("_i") / step, 0)
    near = F.array(j - 1, j, j + 1)
    hit = F.exists(near, lambda c: (c >= 0) & (c <= n - 1) & (F.bround(c * step, 0) == F.col("_i")))
    keep = (F.col("_n") <= n) | hit
    return sized.where(keep).drop("_i", "_n")


def systematic_sample(df: DataFrame, k: int, *keys: str, order: str = "ts") -> DataFrame:
    """Every step-th row so that about ``k`` are taken, the first one included."""
    w = per(*keys, order=order)
    sized = df.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return sized.where((F.col("_i") % step == 0) & (F.col("_i") / step < k)).drop("_i", "_n")
