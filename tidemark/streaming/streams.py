"""Incremental variants as Structured Streaming jobs.

File sources with ``availableNow`` replace the high-water queries: the checkpoint
knows what was read. Sinks are idempotent: a batch that is run again after a failure
leaves the same table. Aggregates are kept as one part per batch and combined on reading,
so no row is too late and no state grows.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.monitor import age_status
from tidemark.sources.lake import Lake


def landing_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a Parquet landing folder; the schema is the one its files have.

    Without ``files_per_trigger`` a run takes all files that have landed.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    schema = reader.parquet(path).schema
    stream = spark.readStream.schema(schema)
    stream = stream if files_per_trigger is None else stream.option("maxFilesPerTrigger", files_per_trigger)
    df = (stream if glob is None else stream.option("pathGlobFilter", glob)).parquet(path)
    casts = {f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def upsert_stream(stream: DataFrame, lake: Lake, dataset: str, keys: Sequence[str], checkpoint: str, version: Column | None = None,
                  partition_cols: Sequence[str] = (), mode: str = "append", fixed_partitions: bool = False) -> StreamingQuery:
    """Each micro-batch is merged into the table; revised rows replace earlier ones.

    Without ``version`` the batch number orders revisions. Only touched partitions are
    rewritten, which is also how late rows enter.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("_version", F.lit(batch_id).cast("bigint") if version is None else version)
        lake.upsert(stamped, dataset, keys, "_version", partition_cols, fixed_partitions)

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(merge).start())


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def part_stream(stream: DataFrame, lake: Lake, dataset: str, checkpoint: str, part: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each micro-batch becomes one partition ``batch`` of ``dataset``, reduced by ``part``.

    Nothing is held as state and nothing waits for a watermark, so rows may come in any
    order and over any number of batches; a batch that runs again overwrites its own
    partition. Readers combine the parts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        lake.write_processed(part(batch).withColumn("batch", F.lit(batch_id).cast("bigint")), dataset, ["batch"])

    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def first_version_stream(stream: DataFrame, lake: Lake, dataset: str, checkpoint: str, key: str) -> StreamingQuery:
    """Rows whose key no earlier batch brought: the first version of a document stays.

    Keys already there are looked up in the partitions of the earlier batches only, so a
    batch that runs again finds what it found before.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        if batch_id:
            known = lake.read(dataset, batch.schema.add("batch", "long")).where(F.col("batch") < batch_id).select(key)
            fresh = fresh.join(known, key, "left_anti")
        lake.write_processed(fresh.withColumn("batch", F.lit(batch_id).cast("bigint")), dataset, ["batch"])

    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def tick_parts(ticks: DataFrame, width: str = "1 day") -> DataFrame:
    """Bars of some (symbol, ts, px, qty, k) ticks, with the order keys of open and close."""
    return ticks.groupBy("symbol", F.window("ts", width).alias("_w")).agg(
        F.min(F.struct("k", "px")).alias("first"), F.max(F.struct("k", "px")).alias("last"), F.max("px").alias("high"),
        F.min("px").alias("low"), F.sum("qty").alias("volume")).select(
        "symbol", F.col("_w.start").alias("ts"), "first", "last", "high", "low", "volume")


def bars_of_parts(parts: DataFrame) -> DataFrame:
    """Whole bars from the parts of any number of batches."""
    return parts.groupBy("symbol", "ts").agg(
        F.min("first")["px"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last")["px"].alias("close"), F.sum("volume").alias("volume"))


def document_parts(docs: DataFrame, slide: str = "1 day") -> DataFrame:
    """Score sum and count of some documents, by symbol and slide."""
    return docs.groupBy("symbol", F.window("published_at", slide).alias("_w")).agg(
        F.sum("sentiment_score").alias("total"), F.count("sentiment_score").alias("n")).select(
        "symbol", F.col("_w.start").alias("cell"), "total", "n")


def windows_of_parts(parts: DataFrame, lookback: str = "30 days", slide: str = "1 day") -> DataFrame:
    """Mean and count of documents for the window ending at each slide; the end is exclusive.

    ``lookback`` is a whole number of slides, so a cell lies in or out of a window.
    """
    cells = parts.groupBy("symbol", "cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return cells.groupBy("symbol", F.window("cell", lookback, slide).alias("_w")).agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("sentiment_score"), F.sum("n").alias("doc_count")).select(
        "symbol", F.col("_w.end").alias("ts"), "sentiment_score", "doc_count")


def freshness_stream(stream: DataFrame, source: str, ts: str, now: Column, lake: Lake, dataset: str, checkpoint: str) -> StreamingQuery:
    """Newest instant per source, judged in each batch; the state is one row per source."""
    latest = stream.groupBy(F.col(source).alias("name")).agg(F.max(ts).alias("latest"))

    def judge(batch: DataFrame, batch_id: int) -> None:
        lake.write_processed(age_status(batch, now), dataset)

    return (latest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(judge).start())


def orders_of_targets(targets: DataFrame) -> DataFrame:
    """Orders from (symbol, ts, target_qty): the change of the target since the one before it in
    event time, in whatever batches and order the targets came. A repeated instant counts
    once, with its latest batch."""
    once = targets.groupBy("symbol", "ts").agg(F.max_by("target_qty", "batch").alias("target_qty"))
    held = F.lag("target_qty", 1, 0.0).over(Window.partitionBy("symbol").orderBy("ts"))
    return once.select("symbol", "ts", (F.col("target_qty") - held).alias("delta")).where(F.abs("delta") >= 1e-9)


def run_sources(starters: Mapping[str, Callable[[], StreamingQuery]]) -> list[tuple[str, str]]:
    """Run one query per source; a failing source does not stop the others."""
    started: list[tuple[str, StreamingQuery | None, str]] = []
    for name, start in starters.items():
        try:
            started.append((name, start(), ""))
        except Exception as exc:  # noqa: BLE001 - isolation between sources is the purpose
            started.append((name, None, f"failed: {type(exc).__name__}"))
    status = []
    for name, q, err in started:
        if q is None:
            status.append((name, err))
            continue
        try:
            q.awaitTermination()
            status.append((name, "ok"))
        except Exception as exc:  # noqa: BLE001
            status.append((name, f"failed: {type(exc).__name__}"))
    return status
