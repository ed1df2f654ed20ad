"""Business-day, session and instant arithmetic as column expressions."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000


def shift_bdays(day: Column, lag: Column | int) -> Column:
    """Weekend days roll forward to Monday, then move ``lag`` weekdays on."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    weekday = F.weekday(day)
    rolled = F.when(weekday >= 5, F.date_add(day, 7 - weekday)).otherwise(day)
    rolled_weekday = F.when(weekday >= 5, F.lit(0)).otherwise(weekday)
    skipped = 2 * F.floor((rolled_weekday + lag) / 5)
    return F.date_add(rolled, (lag + skipped).cast("int"))


def shift_bdays_back(day: Column, lag: Column | int) -> Column:
    """Weekend days roll back to Friday, then move ``lag`` weekdays back."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    weekday = F.weekday(day)
    rolled = F.when(weekday >= 5, F.date_sub(day, weekday - 4)).otherwise(day)
    rolled_weekday = F.when(weekday >= 5, F.lit(4)).otherwise(weekday)
    skipped = 2 * F.floor((4 - rolled_weekday + lag) / 5)
    return F.date_sub(rolled, (lag + skipped).cast("int"))


def lag_for(series: Column, lags: Mapping[str, int]) -> Column:
    """Publication lag of a series; a series that is not listed has none."""
    if not lags:
        return F.lit(0)
    pairs = [F.lit(x) for pair in lags.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[series], F.lit(0))


def age_days(now: Column, ts: Column) -> Column:
    """Age in days, two decimals."""
    return F.round((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(US_PER_DAY), 2)


def deadline(session: Column, offset_days: Column, hour_utc: Column) -> Column:
    """Instant at which a session's data is due."""
    return F.to_timestamp(F.date_add(session, offset_days)) + F.make_interval(hours=hour_utc)


def rfc2822_to_ts(raw: Column) -> Column:
    """Feed dates ("Tue, 02 Jan 2024 10:00:00 GMT") to UTC; anything else is NULL."""
    body = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    # Zone names a feed may carry instead of an offset.
    zones = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "EST": "-0500", "EDT": "-0400",
             "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    for name, offset in zones.items():
        body = F.regexp_replace(body, rf"\s{name}$", f" {offset}")
    return F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z"))


def sessions_of(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """The trading calendar: every day on which any symbol has a bar."""
    return bars.select(F.to_date(ts).alias("session")).distinct()


def sessions_between(sessions: DataFrame, start: str, end: str) -> DataFrame:
    return sessions.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def last_session_on_or_before(sessions: DataFrame, refs: DataFrame, ref: str) -> DataFrame:
    """Adds ``is_session`` and ``last_session`` to dated rows.

    Sessions and reference days form one ordered list of at most one row per
    calendar day and side, so the unpartitioned window stays small.
    """
    from pyspark.sql import Window as W

    days = refs.select(F.col(ref).alias("d")).distinct()
    marks = days.select("d", F.lit(None).cast("date").alias("s")).unionByName(
        sessions.select(F.col("session").alias("d"), F.col("session").alias("s"))
    ).groupBy("d").agg(F.max("s").alias("s"))
    w = W.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    filled = marks.select(
        F.col("d").alias(ref), F.col("s").isNotNull().alias("is_session"),
        F.last("s", ignorenulls=True).over(w).alias("last_session"))
    return refs.join(filled, ref, "left")


def nth_session_before(sessions: DataFrame, n: int) -> DataFrame:
    """For each session, the session ``n`` places earlier (calendar-sized input)."""
    from pyspark.sql import Window as W

    return sessions.withColumn("nth_before", F.lag("session", n).over(W.orderBy("session")))
