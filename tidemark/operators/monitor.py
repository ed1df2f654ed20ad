"""Feed freshness and feature drift."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import age_days, deadline, shift_bdays_back
from tidemark.sources.lake import materialized

# Fixed values of the monitoring rules.
FRED_GRACE_BDAYS = 1
AGE_LIMIT_DAYS = 4
PSI_BINS, PSI_EPSILON, PSI_MIN_PER_BIN, PSI_DRIFT = 10, 1e-4, 5, 0.25
RECENT_BARS, STALE_BARS, DRIFT_Z = 252, 21, 1.0


def required_dates(slas: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Adds ``required_date`` by kind: price_deadline, fred_release, liveness_trading, liveness_calendar.

    Sessions are one row per trading day; each price feed takes the last session
    whose deadline has passed, each trading-day feed the n-th session back.
    """
    past = sessions.where(F.col("session") <= F.to_date(now)).agg(F.sort_array(F.collect_list("session"), False).alias("_ss"))
    s = slas.withColumn("_k", F.lit(1)).join(F.broadcast(past.withColumn("_k", F.lit(1))), "_k")  # one row, calendar-sized
    due = F.filter("_ss", lambda d: deadline(d, F.coalesce("deadline_day_offset", F.lit(0)), F.coalesce("deadline_hour_utc", F.lit(0))) <= now)
    kind = F.col("kind")
    today = F.to_date(now)
    required = (F.when(kind == "price_deadline", F.try_element_at(due, F.lit(1)))
                .when(kind == "fred_release", shift_bdays_back(today, F.coalesce("lag", F.lit(0)) + FRED_GRACE_BDAYS))
                .when(kind == "liveness_trading", F.try_element_at(F.col("_ss"), F.coalesce("max_stale_days", F.lit(0)) + 1))
                .otherwise(F.date_sub(today, F.coalesce("max_stale_days", F.lit(0)))))
    return s.withColumn("required_date", required).drop("_ss", "_k")


def feed_status(with_required: DataFrame, latest: DataFrame) -> DataFrame:
    """fresh, stale or missing per feed; ``latest`` has (name, latest)."""
    j = with_required.join(latest, "name", "left")
    state = (F.when(F.col("latest").isNull(), "missing").when(F.to_date("latest") >= F.col("required_date"), "fresh").otherwise("stale"))
    return j.withColumn("state", state)


def age_status(latest: DataFrame, now: Column, limit: float = AGE_LIMIT_DAYS) -> DataFrame:
    out = latest.withColumn("age_days", age_days(now, F.col("latest")))
    return out.withColumn("status", F.when(F.col("age_days").isNull(), "missing").when(F.col("age_days") <= limit, "fresh").otherwise("stale"))


def freshness_gate(labelled: DataFrame) -> DataFrame:
    """Both kinds of error must be absent on labelled cases (expected, state)."""
    out = labelled.agg(
        F.count_if((F.col("expected") == "fresh") & (F.col("state") != "fresh")).alias("false_stale"),
        F.count_if((F.col("expected") != "fresh") & (F.col("state") == "fresh")).alias("missed_stale"), F.count(F.lit(1)).alias("n_cases"))
    return out.withColumn("passed", (F.col("false_stale") == 0) & (F.col("missed_stale") == 0) & (F.col("n_cases") > 0))


#: Leading bits of a double that make a value bucket: sign, exponent and ten of the fraction, 1024 buckets per power of two.
SHIFT = 42
HIST_BINS = 20
#: Rows that one step of a task counts.
CHUNK = 200_000
#: Stands for a missing day inside a task.
_UNDATED = np.iinfo(np.int64).min


def _value_bucket(x: np.ndarray) -> np.ndarray:
    """A whole number that never falls while x grows: the leading bits of the double, which order like its size."""
    size = (np.abs(x).view(np.int64) >> SHIFT) + 1
    return np.where(x == 0, 0, np.where(x > 0, size, -size))


def _wide(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(day, _x0, _x1, ...): the day from 1970 and the columns as doubles, for tasks that count over them."""
    return panel.select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"),
                        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])


#: Columns to watch, in one table or in several of the same rows (beside prices, ranks that were taken by day).
Panel = DataFrame | Sequence[DataFrame]


def _parts(panel: Panel, columns: Sequence[str]) -> list[tuple[DataFrame, dict[int, str]]]:
    """The tables of a panel, each with the numbers and names of the columns that are read there."""
    tables = [panel] if isinstance(panel, DataFrame) else list(panel)
    where = {c: next((i for i, t in enumerate(tables) if c in t.columns), None) for c in columns}
    missing = [c for c, i in where.items() if i is None]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    parts = [(t, {k: c for k, c in enumerate(columns) if where[c] == i}) for i, t in enumerate(tables)]
    return [(t, mine) for t, mine in parts if mine]


def _over_parts(panel: Panel, columns: Sequence[str], step: Callable[[Sequence[int]], Callable], shape: str) -> DataFrame:
    """What ``step``, made for the numbers of a table's columns, returns over all tables."""
    return reduce(DataFrame.unionByName, [_wide(t, list(mine.values())).mapInArrow(step(list(mine)), shape) for t, mine in _parts(panel, columns)])


def _named(columns: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("number"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _by_day(table: pa.Table, width: int) -> list[np.ndarray]:
    """A chunk's pieces: day, rows, and with a column each: values, their mean and spread, the least and the greatest."""
    # A missing day comes first, as a day of its own.
    number = table["day"].combine_chunks().cast(pa.int64()).fill_null(_UNDATED).to_numpy()
    order = slice(None) if (np.diff(number) >= 0).all() else np.argsort(number, kind="stable")
    number = number[order]
    at = np.flatnonzero(np.append(True, np.diff(number) != 0))
    rows = np.diff(np.append(at, len(number)))
    out = []
    for i in range(width):
        x = table[f"_x{i}"].combine_chunks().to_numpy(zero_copy_only=False)[order]
        seen = ~np.isnan(x)
        n = np.add.reduceat(seen.astype(np.int64), at)
        with np.errstate(all="ignore"):
            mean = np.add.reduceat(np.where(seen, x, 0.0), at) / n
            m2 = np.add.reduceat(np.where(seen, (x - np.repeat(mean, rows)) ** 2, 0.0), at)
        out.append((n, mean, m2, np.fmin.reduceat(x, at), np.fmax.reduceat(x, at)))
    return [number[at], rows, *[np.column_stack(kind) for kind in zip(*out)]]


def _put_together(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Pieces of ``_by_day`` as one piece per day."""
    day = np.concatenate([a[0], b[0]])
    order = np.argsort(day, kind="stable")
    rows, n, mean, m2, low, high = (np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:]))
    at = np.flatnonzero(np.append(True, np.diff(day[order]) != 0))
    add, sizes = (lambda x: np.add.reduceat(x, at)), np.diff(np.append(at, len(day)))
    whole, several = add(n), add((n > 0).astype(np.int64)) > 1
    with np.errstate(all="ignore"):
        # A single piece keeps its own mean.
        middle = np.where(several, add(np.where(n > 0, n * mean, 0.0)) / whole, np.fmax.reduceat(mean, at))
        off = np.where((n > 0) & np.repeat(several, sizes, axis=0), n * (mean - np.repeat(middle, sizes, axis=0)) ** 2, 0.0)
    return [day[order][at], add(rows), whole, middle, add(m2 + off), np.fmin.reduceat(low, at), np.fmax.reduceat(high, at)]


def feature_days(panel: Panel, columns: Sequence[str], recent: int = RECENT_BARS) -> DataFrame:
    """Per feature and day: rows, values, their mean and spread, extremes; whether the day is recent.

    Recent are the last ``recent`` days on which the feature has a value. A task adds up its rows by day, a chunk
    at a time, and returns one piece per column and day in whatever order rows come; then a day's few pieces are
    put together. One row per feature and calendar day is left, so what follows about dates is a window over that.
    """
    def step(numbers: Sequence[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = None
            for table in _chunks(batches):
                chunk = _by_day(table, len(numbers))
                pieces = chunk if pieces is None else _put_together(pieces, chunk)
            if pieces is None:
                return
            day, rows, *kinds = pieces
            own = pa.array(day, mask=day == _UNDATED).cast(pa.int32())
            for i, number in enumerate(numbers):
                n, mean, m2, low, high = (kind[:, i] for kind in kinds)
                none = n == 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(day), number, np.int32)), own, pa.array(rows), pa.array(n),
                    *[pa.array(np.ascontiguousarray(x), mask=none) for x in (mean, m2, low, high)]],
                    ["number", "day", "n_rows", "n", "mean", "m2", "low", "high"])

        return run

    pieces = _over_parts(panel, columns, step, "number int, day int, n_rows bigint, n bigint, mean double, m2 double, low double, high double")
    same = Window.partitionBy("number", "day")
    # A single piece keeps its own mean.
    whole = F.when(F.count_if(F.col("n") > 0).over(same) > 1, F.sum(F.col("n") * F.col("mean")).over(same) / F.nullif(F.sum("n").over(same), F.lit(0))).otherwise(F.max("mean").over(same))
    days = pieces.withColumn("_mean", whole).groupBy("number", "day").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))
    days = days.withColumns({"feature": _named(columns), "day": F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))}).drop("number")
    mine = Window.partitionBy("feature")
    place = F.row_number().over(mine.orderBy((F.col("n") > 0).desc(), F.col("day").desc()))
    return days.withColumns({"n_dates": F.count_if(F.col("n") > 0).over(mine), "last_valid": F.max(F.when(F.col("n") > 0, F.col("day"))).over(mine),
                             "is_recent": (F.col("n") > 0) & (place <= recent)})


def _counter(numbers: Sequence[int], ends: Sequence[tuple], hist: int, kept: Sequence[np.ndarray] | None):
    """A step over the columns of a chunk: values counted by side, bucket and bar, or only those of the ``kept`` buckets, one by one.

    ``numbers`` are those of the chunk's columns. ``ends`` has the first recent day (from 1970), the least and the greatest value of every column.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            day = table["day"].combine_chunks()
            undated = day.is_null().to_numpy(zero_copy_only=False)
            day = day.fill_null(0).to_numpy()
            for i, number in enumerate(numbers):
                start, low, high = ends[number]
                x = table[f"_x{i}"].combine_chunks().to_numpy(zero_copy_only=False) + 0.0  # no negative zero
                dated = ~undated & ~np.isnan(x)
                recent = np.zeros(len(x), bool) if start is None else day >= start
                for side, rows in ((True, dated & recent), (False, dated & ~recent), (None, undated & ~np.isnan(x))):
                    mine = x[rows]
                    if kept is not None:
                        mine = mine[np.isin(_value_bucket(mine), kept[number])]
                    mine = np.sort(mine)
                    bucket, bar = _value_bucket(mine), np.full(len(mine), float(hist // 2))
                    if high > low:
                        with np.errstate(all="ignore"):
                            bar = np.nan_to_num(np.minimum(np.floor((mine - low) / (high - low) * hist), hist - 1))
                    new = np.ones(len(mine), bool)  # buckets and bars never fall, so equal ones stand together
                    new[1:] = mine[1:] != mine[:-1] if kept is not None else (bucket[1:] != bucket[:-1]) | (bar[1:] != bar[:-1])
                    at = np.flatnonzero(new)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), number, np.int32)), pa.array([side] * len(at), pa.bool_()), pa.array(bucket[at]),
                        pa.array(bar[at].astype(np.int32)), pa.array(mine[at]), pa.array(np.diff(np.append(at, len(mine))).astype(np.int64))],
                        ["number", "is_recent", "bucket", "bar", "x", "n"])

    return run


def feature_values(panel: Panel, columns: Sequence[str], days: DataFrame, bins: int = PSI_BINS,
                   hist: int = HIST_BINS) -> tuple[DataFrame, DataFrame]:
    """All values of all columns, counted, and where the baseline's order statistics lie.

    First all values are counted by value bucket. Then only those in buckets that hold an order
    statistic of a baseline quantile are read again and kept apart; elsewhere the least value of a
    bucket stands for all of it. So the baseline's quantiles, the values between any two of them and
    the histogram follow exactly from counts. Tasks count over the columns of a chunk of rows, and
    partial aggregation adds their counts up: values never become rows, and no column is sorted as a whole.

    Returns (feature, is_recent, bucket, bar, x, exact, n), ``bar`` being the bar of a histogram
    of ``hist`` bars of equal width, and (feature, bucket, first, top) of those buckets: how many
    baseline values lie below, and the place of the last one. Both are written.
    """
    spark = days.sparkSession
    # One row per declared column; its numbers become constants of the pass over the panel.
    found = {r.feature: r for r in days.groupBy("feature").agg(
        F.datediff(F.min(F.when(F.col("is_recent"), F.col("day"))), F.lit("1970-01-01").cast("date")).alias("start"),
        F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    live = [c for c in columns if c in found and found[c].low is not None]
    shape = "feature string, is_recent boolean, bucket bigint, bar int, x double, exact boolean, n bigint"
    if not live:
        return spark.createDataFrame([], shape), spark.createDataFrame([], "feature string, bucket bigint, first bigint, top bigint")
    ends = [(found[c].start, found[c].low, found[c].high) for c in live]
    cells = "number int, is_recent boolean, bucket bigint, bar int, x double, n bigint"
    coarse = materialized(_over_parts(panel, live, lambda numbers: _counter(numbers, ends, hist, None), cells).groupBy("number", "is_recent", "bucket", "bar").agg(
        F.min("x").alias("x"), F.sum("n").alias("n")))
    base = coarse.where("NOT is_recent").groupBy("number", "bucket").agg(F.sum("n").alias("n"))
    mine = Window.partitionBy("number")
    # Counted buckets: at most as many as there are leading bits of doubles.
    base = base.withColumns({"last": F.sum("n").over(mine.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - 1,
                             "top": F.sum("n").over(mine) - 1}).withColumn("first", F.col("last") - F.col("n") + 1)
    holds = F.lit(False)
    for i in range(bins + 1):
        at = F.floor(F.lit(i / bins) * F.col("top"))
        holds = holds | ((at <= F.col("last")) & (F.least(at + 1, F.col("top")) >= F.col("first")))
    name = _named(live)
    places = materialized(base.where(holds).select("number", name.alias("feature"), "bucket", "first", "top"))
    # At most two buckets per quantile and column.
    kept = [[] for _ in live]
    for row in places.select("number", "bucket").collect():
        kept[row.number].append(row.bucket)
    kept = [np.array(k, np.int64) for k in kept]
    apart = _over_parts(panel, live, lambda numbers: _counter(numbers, ends, hist, kept), cells).groupBy(
        "number", "is_recent", "bucket", "bar", "x").agg(F.sum("n").alias("n")).withColumn("exact", F.lit(True))
    rest = coarse.join(F.broadcast(places.select("number", "bucket")), ["number", "bucket"], "left_anti").withColumn("exact", F.lit(False))
    values = apart.unionByName(rest).select(name.alias("feature"), "is_recent", "bucket", "bar", "x", "exact", "n")
    return materialized(values), places.drop("number")


def baseline_edges(values: DataFrame, places: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(feature, edges): distinct interpolated quantiles of the baseline, from the buckets that hold them."""
    kept = values.where("exact AND NOT is_recent").groupBy("feature", "bucket", "x").agg(F.sum("n").alias("n"))
    # At most two buckets per quantile and column.
    kept = kept.join(F.broadcast(places), ["feature", "bucket"])
    line = Window.partitionBy("feature", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_last", F.col("first") + F.sum("n").over(line) - 1).withColumn("_first", F.col("_last") - F.col("n") + 1)
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i / bins).alias("q")) for i in range(bins + 1)])
    hits = kept.withColumn("_s", F.explode(cuts))
    at = F.col("_s.q") * F.col("top")
    low, high = F.floor(at), F.least(F.floor(at) + 1, F.col("top"))
    share = at - low
    weight = (F.when(low.between(F.col("_first"), F.col("_last")), 1 - share).otherwise(0.0)
              + F.when(high.between(F.col("_first"), F.col("_last")), share).otherwise(0.0))
    per = hits.where(low.between(F.col("_first"), F.col("_last")) | high.between(F.col("_first"), F.col("_last"))).groupBy(
        "feature", "_s.i").agg(F.sum(weight * F.col("x")).alias("e"))
    return per.groupBy("feature").agg(F.array_sort(F.collect_set("e")).alias("edges"))


def psi(values: DataFrame, places: DataFrame, days: DataFrame, bins: int = PSI_BINS, epsilon: float = PSI_EPSILON,
        min_per_bin: int = PSI_MIN_PER_BIN, recent: int = RECENT_BARS) -> DataFrame:
    """Stability index per feature of recent against earlier values, NULL where undefined.

    Interpolated baseline quantiles are the bin edges, repeats removed; values are
    clipped, the last bin is closed.
    """
    new, old = F.sum(F.when(F.col("is_recent"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("is_recent"), 0).otherwise(F.col("n")))
    # One row per feature: the declared columns.
    j = values.join(F.broadcast(baseline_edges(values, places, bins).where(F.size("edges") >= 2)), "feature", "left")
    # Where a bucket's values are not kept apart, no edge lies inside it: its least value falls like all of them.
    inner = F.slice("edges", 2, F.size("edges") - 2)
    bin_ = F.when(F.col("edges").isNotNull(), F.size(F.filter(inner, lambda e: e <= F.col("x"))))
    counts = j.groupBy("feature", bin_.alias("bin")).agg(new.alias("r"), old.alias("b"))
    mine = Window.partitionBy("feature")
    pct = counts.withColumns({"n_recent": F.sum("r").over(mine), "n_base": F.sum("b").over(mine)})
    rr, bb = F.col("r") / F.nullif("n_recent", F.lit(0)), F.col("b") / F.nullif("n_base", F.lit(0))
    # A bin empty on both sides adds (eps - eps) * ln(1) = 0, so leaving it out changes nothing.
    rr, bb = (F.when(c == 0, F.lit(epsilon)).otherwise(c) for c in (rr, bb))
    summed = pct.groupBy("feature").agg(F.sum(F.when(F.col("bin").isNotNull(), (rr - bb) * F.ln(rr / bb))).alias("_psi"),
                                        F.max("n_recent").alias("n_recent"), F.max("n_base").alias("n_base"))
    dates = F.broadcast(days.groupBy("feature").agg(F.max("n_dates").alias("n_dates")))
    enough = (F.col("n_recent") >= bins * min_per_bin) & (F.col("n_base") >= bins * min_per_bin) & (F.col("n_dates") > recent + 1)
    return summed.join(dates, "feature").select("feature", F.when(enough, F.col("_psi")).alias("psi"))


def drift_psi(panel: Panel, columns: Sequence[str], recent: int = RECENT_BARS) -> DataFrame:
    """The stability index of the last ``recent`` dates of every column. The panel is read three times: pass written tables."""
    days = materialized(feature_days(panel, columns, recent))
    return psi(*feature_values(panel, columns, days), days, recent=recent)


def feature_stats(panel: Panel, columns: Sequence[str], recent: int = RECENT_BARS, stale_bars: int = STALE_BARS,
                  drift_z: float = DRIFT_Z, hist: int = HIST_BINS) -> DataFrame:
    """Coverage, moments, distribution, PSI and a stable / drifting / stale verdict per feature.

    ``distribution`` counts values in ``hist`` bars of equal width between the extremes. A column
    without values has coverage 0, no moments, and is stale. The panel is read three times: pass written tables.
    """
    days = materialized(feature_days(panel, columns, recent))
    values, places = feature_values(panel, columns, days, hist=hist)
    n, m = F.sum("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    recent_mean, base_mean = F.when(F.col("is_recent"), F.col("mean")), F.when(~F.col("is_recent"), F.col("mean"))
    base = days.groupBy("feature").agg(
        F.sum("n_rows").alias("n_rows"), n.alias("n"), m.alias("mean"), F.sum("m2").alias("_m2"),
        F.max("last_valid").alias("last_valid"), F.count_if(F.col("day") > F.col("last_valid")).alias("dates_behind"),
        F.abs(F.avg(recent_mean) - F.avg(base_mean)).alias("shift"), F.stddev_samp(base_mean).alias("base_std"), F.max("n_dates").alias("n_dates"))
    # Spread of all values: spreads within days, and of the days' means around the whole mean.
    around = days.join(F.broadcast(base.select("feature", F.col("mean").alias("_mean"))), "feature").groupBy("feature").agg(
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("_around"))
    bars = values.groupBy("feature", "bar").agg(F.sum("n").alias("n")).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bar").cast("int").alias("k"), F.col("n").alias("v")))).alias("_bars"))
    j = base.join(around, "feature").join(bars, "feature", "left").join(psi(values, places, days, recent=recent), "feature", "left")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_around") / F.nullif(F.col("n") - 1, F.lit(0)))).when(F.col("n") == 1, 0.0)
    slots = F.transform(F.sequence(F.lit(0), F.lit(hist - 1)), lambda k: F.coalesce(F.try_element_at("_bars", k), F.lit(0).cast("bigint")))
    mean_drift = F.when(F.coalesce("base_std", F.lit(0.0)) == 0, F.col("shift") > 0).otherwise(F.col("shift") / F.nullif("base_std", F.lit(0.0)) >= drift_z)
    judged = F.coalesce((F.col("n_dates") > recent + 1) & mean_drift, F.lit(False)) | F.coalesce(F.col("psi") >= PSI_DRIFT, F.lit(False))
    verdict = F.when(F.col("last_valid").isNull() | (F.col("dates_behind") > stale_bars), "stale").when(judged, "drifting").otherwise("stable")
    return j.select("feature", "n_rows", (F.col("n") / F.col("n_rows")).alias("coverage"), "mean", std.alias("std"), "psi",
                    F.when(F.col("n") > 0, slots).alias("distribution"), verdict.alias("verdict"))


def missing_series(expected: DataFrame, present: DataFrame, key: str = "series_id") -> DataFrame:
    return expected.join(present.select(key).distinct(), key, "left_anti")
