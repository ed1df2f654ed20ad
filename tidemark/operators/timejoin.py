"""Time joins without look-ahead: as-of, interval and range joins."""
from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tidemark.functions.dates import lag_for, shift_bdays
from tidemark.sources.lake import materialized


def calendar(spark, start: str, end: str) -> DataFrame:
    """One row per calendar day from ``start`` to ``end``."""
    days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    return spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))


def macro_calendar(obs: DataFrame, series: Sequence[str], start: str, end: str,
                   lags: Mapping[str, int] | None = None) -> DataFrame:
    """Wide table with, for each day, the latest value each series had published.

    Observations move forward by their lag in business days; several landing on
    one day keep the latest. Those published before ``start`` are carried onto it.
    The result has one row per calendar day: its size is fixed by the arguments.
    """
    avail = shift_bdays(F.to_date("timestamp"), lag_for(F.col("series_id"), lags or {})) if lags \
        else F.to_date("timestamp")
    first = F.lit(start).cast("date")
    landed = (
        obs.where(F.col("series_id").isin(*series) & F.col("value").isNotNull() & ~F.isnan("value"))
        .select("series_id", "value", "timestamp", F.greatest(avail, first).alias("day"))
        .where(F.col("day") <= F.lit(end).cast("date"))
    )
    wide = landed.groupBy("day").pivot("series_id", list(series)).agg(F.max_by("value", "timestamp"))
    filled = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return calendar(obs.sparkSession, start, end).join(wide, "day", "left").select(
        "day", *[F.last(s, ignorenulls=True).over(filled).alias(s) for s in series])


def attach_macro(bars: DataFrame, obs: DataFrame, series: Sequence[str], start: str, end: str,
                 lags: Mapping[str, int] | None = None) -> DataFrame:
    """Backward as-of join at day grain: bars x calendar of published values.

    The calendar's row count follows from ``start`` and ``end``, so it is broadcast: left to itself,
    Spark may shuffle the bars by day before it has seen how small the calendar is.
    """
    cal = macro_calendar(obs, series, start, end, lags)
    return bars.join(F.broadcast(cal), F.to_date("ts") == F.col("day"), "left").drop("day")


#: Rows of one key and time bucket from which on the bucket is cut further, and into how many pieces at most.
CROWDED, PIECES = 200_000, 64


#: Width of a time bucket, in seconds: 32 days. Dense stretches are cut by their rows, so it need not be small.
BUCKET = 32 * 86_400


def time_buckets(line: DataFrame, by: Sequence[str], bucket_seconds: int = BUCKET, crowded: int = CROWDED) -> DataFrame:
    """Adds ``_b`` and ``_sub``, which order like ``_ts`` within a key, and ``_copies``.

    A bucket is a stretch of time. A bucket of a key with more than ``crowded`` rows is cut at
    quantiles of its own rows, so pieces hold about equally many. An instant that holds several
    pieces' worth of rows cannot be cut by time: ``_copies`` says how many pieces, over which
    rows that don't depend on each other may be dealt. The list of crowded buckets, at most
    rows / ``crowded``, is written, so that its size is known when it is joined.
    """
    by = list(by)
    at = F.unix_micros("_ts")
    line = line.withColumn("_b", F.floor(F.unix_seconds("_ts") / bucket_seconds))
    keys = [*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb")]
    same = F.col("_b") == F.col("_kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    sizes = line.where("_ts IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded)
    hot = materialized(sizes)
    if hot.isEmpty():
        return line.withColumns({"_sub": F.lit(0), "_copies": F.lit(1)})
    cuts = [i / PIECES for i in range(1, PIECES)]
    quantiles = line.join(hot, same).groupBy(*[c for c in hot.columns]).agg(F.percentile_approx(at, cuts, 10_000).alias("_cuts"))
    # Only as many pieces as are needed: every k-th quantile.
    step = F.greatest(F.lit(1), F.floor(F.lit(PIECES) * crowded / F.col("_n"))).cast("int")
    taken = F.transform(F.sequence(step, F.lit(PIECES - 1), step), lambda i: F.element_at("_cuts", i))
    hot = materialized(quantiles.withColumn("_cuts", taken).drop("_n"))
    joined = line.join(hot, same, "left").drop(*[f"_k{i}" for i in range(len(by))], "_kb")
    distinct = F.array_distinct("_cuts")
    sub = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter(distinct, lambda c: c < at)))
    ends = F.get(distinct, F.col("_sub"))  # the piece's last instant; none for the last piece
    copies = F.coalesce(F.size(F.filter("_cuts", lambda c: c == ends)), F.lit(1))
    return joined.withColumn("_sub", sub).withColumn("_copies", F.when(
        F.col("_cuts").isNull() | ends.isNull(), 1).otherwise(F.greatest(copies, F.lit(1)))).drop("_cuts")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              values: Sequence[str], direction: str = "backward", allow_exact: bool = True,
              bucket_seconds: int = BUCKET, crowded: int = CROWDED) -> DataFrame:
    """General as-of join: for each left row the nearest right row in time.

    Both sides are cut into (key, time bucket), crowded buckets further (``time_buckets``).
    Every piece starts with the value carried into it, so one window fills it. Rows of the right
    side are reduced to one per instant, and left rows of an instant that fills several pieces
    are dealt over as many tasks: no key, day or instant has to fit in a task. Only the
    summary, one row per key and piece, is ordered per key. Left rows without a time get no value.
    """
    by = list(by)
    back = direction == "backward"
    value = F.struct(F.col(right_ts).alias("_rts"), *[F.col(v).alias(v) for v in values])
    lhs = left.select(*by, F.col(left_ts).cast("timestamp").alias("_ts"), F.struct(*left.columns).alias("_row"))
    rhs = right.where(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).cast("timestamp").alias("_ts"), value.alias("_v"))
    pick = F.max if back else F.min
    rhs = rhs.groupBy(*by, "_ts").agg(pick("_v").alias("_v"))
    lhs_side, rhs_side = (1, 0) if allow_exact == back else (0, 1)
    line = lhs.withColumn("_side", F.lit(lhs_side)).unionByName(rhs.withColumn("_side", F.lit(rhs_side)), allowMissingColumns=True)
    line = time_buckets(line, by, bucket_seconds, crowded)

    piece = [*by, "_b", "_sub"]
    pick_by = F.max_by if back else F.min_by
    summary = line.where("_b IS NOT NULL").groupBy(*piece).agg(
        pick_by("_v", F.when(F.col("_v").isNotNull(), F.col("_ts"))).alias("_last"), F.max("_copies").alias("_copies"))
    order = [F.col("_b"), F.col("_sub")]
    per_key = Window.partitionBy(*by).orderBy(*[c if back else c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("_v", F.last("_last", ignorenulls=True).over(per_key)).where("_v IS NOT NULL").drop("_last")

    every = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))
    own = line.where("_row IS NOT NULL").withColumn("_copy", F.when(
        F.col("_ts").isNull(), F.pmod(F.xxhash64("_row"), F.lit(PIECES))).otherwise(F.pmod(F.xxhash64("_row"), F.col("_copies"))).cast("int"))
    said = line.where("_v IS NOT NULL").withColumn("_copy", every)
    start = carried.withColumn("_copy", every).withColumn("_side", F.lit(-1))
    whole = own.unionByName(said).unionByName(start, allowMissingColumns=True)
    # The carried value first (side -1 without a time), then by time.
    within = [F.col("_ts").isNotNull(), F.col("_ts") if back else F.col("_ts").desc(), F.col("_side") if back else F.col("_side").desc()]
    inside = Window.partitionBy(*piece, "_copy").orderBy(*within).rowsBetween(Window.unboundedPreceding, 0)
    out = whole.withColumn("_hit", F.last("_v", ignorenulls=True).over(inside)).where("_row IS NOT NULL")
    return out.select("_row.*", F.col("_hit._rts").alias(f"asof_{right_ts}"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def pit_latest(bars: DataFrame, asof: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Most recent bar per symbol with ts <= asof, as one partial aggregation."""
    rest = [c for c in bars.columns if c != key]
    latest = bars.where(F.col(ts) <= F.lit(asof).cast("timestamp")).groupBy(key).agg(
        F.max_by(F.struct(*rest), ts).alias("_r"))
    return latest.select(key, "_r.*")


def pit_panel(bars: DataFrame, asof: str, symbols: Sequence[str] | None = None, ts: str = "ts") -> DataFrame:
    kept = bars.where(F.col(ts) <= F.lit(asof).cast("timestamp"))
    return kept.where(F.col("symbol").isin(*symbols)) if symbols else kept


def document_windows(docs: DataFrame, bars: DataFrame, lookback_days: int = 30, crowded: int = CROWDED) -> DataFrame:
    """Mean score, count and coverage of documents in [bar - lookback, bar).

    A window is the difference of two prefix sums, one at the bar and one at its lookback: the
    totals of earlier days and pieces of days, carried over, and the sum inside the piece. So no
    task sees a symbol's whole line, crowded days are cut (``time_buckets``), and no (document,
    bar) pairs are made. At one instant, bars come before documents: a bar never sees a
    document published at its own instant or later. Bars whose ``ts`` is a DATE are whole days
    by type: ``_daily_windows``.
    """
    if isinstance(bars.schema["ts"].dataType, DateType) and lookback_days > 0:
        return _daily_windows(docs, bars, lookback_days)
    said = docs.where("published_at IS NOT NULL").groupBy("symbol", F.col("published_at").alias("_ts")).agg(
        F.sum("sentiment_score").alias("_s"), F.count("sentiment_score").alias("_k"))
    ends = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.lit(0).alias("days")),
                             F.struct(F.lit(-1).alias("sign"), F.lit(lookback_days).alias("days"))))
    points = bars.where("ts IS NOT NULL").select("symbol", F.col("ts").alias("_bar")).withColumn("_e", ends)
    points = points.select("symbol", (F.col("_bar").cast("timestamp") - F.make_dt_interval(days=F.col("_e.days"))).alias("_ts"), "_bar", "_e.sign")
    line = time_buckets(said.unionByName(points, allowMissingColumns=True), ["symbol"], crowded=crowded).drop("_copies")

    piece = ["symbol", "_b", "_sub"]
    totals = line.groupBy(*piece).agg(F.sum("_s").alias("_s"), F.sum("_k").alias("_k"))
    before = Window.partitionBy("symbol").orderBy("_b", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*piece, F.sum("_s").over(before).alias("_s"), F.sum("_k").over(before).alias("_k"))
    whole = line.unionByName(carried.where("_k > 0"), allowMissingColumns=True)
    # The carried sums have no time and come first; of one instant, bars come before documents.
    inside = Window.partitionBy(*piece).orderBy(F.col("_ts").isNotNull(), "_ts", F.col("_bar").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    sums = whole.withColumns({"_s": F.sum("_s").over(inside), "_k": F.sum("_k").over(inside)}).where("_bar IS NOT NULL")
    at = lambda x, sign: F.coalesce(F.max(F.when(F.col("sign") == sign, F.col(x))), F.lit(0))  # noqa: E731  repeated bars count once
    seen = sums.groupBy("symbol", F.col("_bar").alias("ts")).agg(
        (at("_s", 1) - at("_s", -1)).alias("_total"), (at("_k", 1) - at("_k", -1)).alias("doc_count"))
    return _scored(seen)


def _scored(seen: DataFrame) -> DataFrame:
    """Mean score, 0 without documents, from the total and number of a bar's documents."""
    return seen.select("symbol", "ts", F.when(F.col("doc_count") > 0, F.col("_total") / F.nullif("doc_count", F.lit(0))).otherwise(0.0).alias("sentiment_score"),
                       "doc_count", (F.col("doc_count") > 0).alias("has_coverage"))


def _said_by_day(docs: DataFrame) -> DataFrame:
    """(symbol, _day from 1970, _s, _k): total and number of a day's scores."""
    return docs.where("published_at IS NOT NULL").groupBy(
        "symbol", F.datediff(F.to_date("published_at"), F.lit("1970-01-01").cast("date")).alias("_day")).agg(
        F.sum("sentiment_score").alias("_s"), F.count("sentiment_score").alias("_k"))


def with_daily_documents(bars: DataFrame, docs: DataFrame, lookback_days: int = 30) -> DataFrame:
    """``bars`` with the columns of their ``document_windows``, for bars that are whole days; needs no join.

    Days with documents stand in a symbol's line beside its bars, as in ``_daily_windows``, but the bars stay
    whole: rows are shuffled once, by symbol, and windows over a symbol that follow use the same shuffle.
    """
    if lookback_days < 1:
        raise ValueError("a lookback of whole days has one day at least")
    marks = bars.withColumns({"_bar": F.lit(True), "_day": F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))})
    reach = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-lookback_days, -1)
    line = marks.unionByName(_said_by_day(docs), allowMissingColumns=True)
    line = line.withColumns({"_total": F.sum("_s").over(reach), "_n": F.sum("_k").over(reach)}).where("_bar")
    # A bar without symbol or time is no bar of a document's symbol.
    known = F.col("symbol").isNotNull() & F.col("ts").isNotNull()
    n = F.coalesce("_n", F.lit(0))
    mean = F.when(n > 0, F.col("_total") / F.nullif(n, F.lit(0))).otherwise(0.0)
    return line.select(*bars.columns, F.when(known, mean).alias("sentiment_score"), F.when(known, n).alias("doc_count"),
                       F.when(known, n > 0).alias("has_coverage"))


def _daily_windows(docs: DataFrame, bars: DataFrame, lookback_days: int) -> DataFrame:
    """``document_windows`` of whole days: a symbol's line has one row per day with documents and one per bar.

    Partial aggregation reduces documents to days, so a line is bounded by the calendar and one range
    frame over it, from ``lookback_days`` back to the day before, is the window.
    """
    epoch = F.lit("1970-01-01").cast("date")
    said = _said_by_day(docs)
    marks = bars.where("ts IS NOT NULL").select("symbol", F.datediff("ts", epoch).alias("_day"), "ts")
    reach = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-lookback_days, -1)
    line = said.unionByName(marks, allowMissingColumns=True).withColumns({"_total": F.sum("_s").over(reach), "doc_count": F.sum("_k").over(reach)})
    seen = line.where("ts IS NOT NULL").groupBy("symbol", "ts").agg(  # repeated bars count once
        F.max("_total").alias("_total"), F.coalesce(F.max("doc_count"), F.lit(0)).alias("doc_count"))
    return _scored(seen)


def first_bar_after(docs: DataFrame, bars: DataFrame) -> DataFrame:
    """Forward as-of: the first bar strictly after each publication."""
    marks = bars.select("symbol", F.col("ts").alias("bar_ts"))
    return asof_join(docs, marks, ["symbol"], "published_at", "bar_ts", [], direction="forward", allow_exact=False)


def master_calendar(panel: DataFrame, ts: str = "ts") -> DataFrame:
    """Every date any symbol has, numbered from 0 (calendar-sized)."""
    days = panel.select(ts).distinct()
    return days.withColumn("pos", (F.row_number().over(Window.orderBy(ts)) - 1).cast("bigint"))


def align_series(rows: DataFrame, series: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """All ``rows`` with the values of per-symbol ``series``; no value at a row's instant is NULL.

    A key that ``series`` holds twice would repeat rows, so its rows are reduced to one by
    their largest value. Columns of the same name in both are an error, not a guess.
    """
    clash = set(rows.columns) & set(series.columns) - set(keys)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    values = [c for c in series.columns if c not in keys]
    single = series.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_s"))
    return rows.join(single, list(keys), "left").select(*rows.columns, *[F.col(f"_s.{c}").alias(c) for c in values])
