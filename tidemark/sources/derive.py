"""Panel inputs derived from the star-schema tables.

Everything grows with its source: bars with ``lineitem`` (one symbol per supplier),
macro series with ``orders``, scored documents with ``events``. A symbol never has
more rows than there are calendar days, however many line items it holds, so the
per-symbol windows built on bars stay calendar-sized.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_utc

SERIES = ("DGS10", "DFF", "VIXCLS")


class Tables:
    """Lazy readers for one data directory.

    ``sources`` puts other inputs in the place of ``bars``, ``macro`` or ``docs``: functions of
    the tables that return a DataFrame of the same columns. Every plan asks the tables for its
    inputs, so a plan runs on an injected source unchanged.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, sources: Mapping[str, Callable[[Tables], DataFrame]] | None = None):
        self.spark = ensure_utc(spark)
        self.dir = sf_dir.rstrip("/")
        self.sources = dict(sources or {})
        self._written: dict[str, DataFrame] = {}
        unknown = set(self.sources) - {"bars", "macro", "docs"}
        if unknown:
            raise ValueError(f"no such source: {sorted(unknown)}")

    def with_sources(self, **sources: Callable[[Tables], DataFrame]) -> Tables:
        return Tables(self.spark, self.dir, self.sources | sources)

    def _source(self, name: str, default: Callable[[], DataFrame], columns: Sequence[str]) -> DataFrame:
        if name not in self.sources:
            return default()
        found = self.sources[name](self)
        missing = set(columns) - set(found.columns)
        if missing:
            raise ValueError(f"source {name!r} lacks {sorted(missing)}")
        return found

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """An intermediate that several branches of one query read, written at its first use."""
        from tidemark.sources.lake import materialized

        if name not in self._written:
            self._written[name] = materialized(build())
        return self._written[name]

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(casts) if casts else df

    def bars(self) -> DataFrame:
        return self._source("bars", lambda: daily_bars(self.raw("lineitem")), ("symbol", "ts", "open", "high", "low", "close", "volume"))

    def macro(self) -> DataFrame:
        return self._source("macro", lambda: macro_long(self.raw("orders")), ("series_id", "timestamp", "value"))

    def docs(self) -> DataFrame:
        return self._source("docs", lambda: scored_documents(self.raw("events")), ("document_id", "symbol", "published_at", "sentiment_score"))

    def returns(self) -> DataFrame:
        """One return series per symbol, used as independent runs."""
        from tidemark.operators.windows import pct_change

        out = self.bars().select(F.col("symbol").alias("run"), "ts", pct_change("close", 1).alias("ret"))
        return out.where("ret IS NOT NULL")


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """Ticks to daily bars in one partial aggregation.

    The tick order is packed in one BIGINT, so first and last are hash aggregates
    with map-side combining: a supplier holding a third of all rows is reduced
    before the shuffle.
    """
    tick = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey") % 1048576
    ticks = lineitem.select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (100 + F.col("l_extendedprice") / 20011.7).alias("px"),
        (F.col("l_quantity") * 1000 + F.col("l_extendedprice") / 10).alias("qty"),
        tick.alias("k"),
    )
    return ticks.groupBy("symbol", "ts").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"), F.sum("qty").alias("volume"))


def macro_long(orders: DataFrame) -> DataFrame:
    series = (F.when(F.col("o_orderpriority") == "1-URGENT", "DGS10")
              .when(F.col("o_orderpriority") == "2-HIGH", "DFF")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "VIXCLS")
              .otherwise(F.col("o_orderpriority")))
    return orders.groupBy(series.alias("series_id"), F.col("o_orderdate").alias("timestamp")).agg(
        (F.max_by("o_totalprice", "o_orderkey") / 15000).alias("value"))


def scored_documents(events: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 49.7))
    return events.select(
        F.col("event_id").alias("document_id"),
        F.concat(F.lit("S"), "user_id").alias("symbol"),
        (F.col("ts") - F.expr("INTERVAL 25 YEARS")).alias("published_at"),
        score.alias("sentiment_score"))
