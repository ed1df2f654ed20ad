"""Two-layer Parquet lake: raw landings by ingest day, processed sets by month."""
from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the cluster's checkpoint folder.

    A local folder is taken only where none is set and the session is local.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        name = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
        return f"{shared.rstrip('/')}/tidemark-{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="spark-")


#: Whether Spark drops a query's shuffle files when the query ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialized(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and read it back.

    The table lives in the shared folder, so branches do not recompute their common
    part, lost executors cost nothing, and later joins see real sizes. What was shuffled
    for it is given back once it is written, not when the driver next collects garbage.
    """
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/table"
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def raw_path(self, source: str, dataset: str) -> str:
        return f"{self.root}/raw/{source}/{dataset}"

    def path(self, dataset: str) -> str:
        return f"{self.root}/processed/{dataset}"

    def write_raw(self, df: DataFrame, source: str, dataset: str, day: str) -> None:
        """One ``dt=`` partition per ingest day; running a day again replaces it."""
        out = df.withColumn("dt", F.lit(day).cast("date"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(
            self.raw_path(source, dataset))

    def write_processed(self, df: DataFrame, dataset: str, partition_cols: Sequence[str] = ()) -> None:
        """Replace only the partitions present in ``df``.

        The rebalance hint gathers a partition's rows into few files and lets the
        adaptive planner split a partition that is too large for one task.
        """
        if not partition_cols:
            df.write.mode("overwrite").parquet(self.path(dataset))
            return
        (df.hint("rebalance", *[F.col(c) for c in partition_cols]).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(self.path(dataset)))

    def write_ordered(self, df: DataFrame, dataset: str, keys: Sequence[str], position: str = "position") -> None:
        """A total order at the sink: files follow each other by ``keys``, and rows carry their position from 0.

        Rows are range-partitioned and sorted by the keys and, where those tie, by the other
        columns, so the same rows get the same positions again. Positions are offsets of
        partitions, a few counts, plus places inside them; no row is ranked in one task.
        """
        order = [*keys, *[c for c in df.columns if c not in keys and not isinstance(df.schema[c].dataType, MapType)]]
        stage = f"{scratch_dir(self.spark)}/sorted"
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
        placed.write.parquet(stage)
        rows = self.spark.read.schema(placed.schema).parquet(stage)
        part = F.shiftright("_m", 33)
        sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        # One row per written partition.
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
        out = rows.withColumn("_part", part).join(offsets, "_part").withColumn(
            position, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1))
        out.select(*df.columns, position).write.mode("overwrite").parquet(self.path(dataset))

    def read(self, dataset: str, schema: StructType | str | None = None) -> DataFrame:
        """A dataset that was never written reads as empty when its schema is given."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(self.path(dataset))
        except AnalysisException as exc:
            if schema is None or "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def query(self, sql: str, datasets: Sequence[str], args: Sequence | Mapping | None = None) -> DataFrame:
        """SQL over datasets registered as views of the same name; ``args`` bind ? or :name."""
        for d in datasets:
            self.read(d).createOrReplaceTempView(d)
        return self.spark.sql(sql, args=args)

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _remove(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def _recover(self, dataset: str) -> None:
        """Finish a flat upsert that stopped between deleting the live table and writing it.

        A committed staging copy without a committed live table is the whole table.
        """
        stage, live = f"{self.root}/staging/{dataset}", self.path(dataset)
        if self._exists(f"{stage}/_SUCCESS") and not self._exists(f"{live}/_SUCCESS"):
            self.spark.read.parquet(stage).write.mode("overwrite").parquet(live)

    def upsert(self, new: DataFrame, dataset: str, keys: Sequence[str], version: str,
               partition_cols: Sequence[str] = (), fixed_partitions: bool = False) -> None:
        """Merge new rows; per key the row with the latest ``version`` stays.

        Only partitions that ``new`` touches are rewritten, and those that hold an older row
        of one of its keys: a key may move to another partition. With ``fixed_partitions`` the
        caller states that a key determines its partition, and no other partition is looked
        at. Partition names (one per month) are the only thing the driver sees. A rerun gives
        the same result, so a job that stopped anywhere can simply be started again.
        """
        if not partition_cols:
            self._recover(dataset)
        try:
            old = self.spark.read.parquet(self.path(dataset))
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            old = None
        touched = []
        if old is not None:
            if partition_cols:
                parts = new.select(*partition_cols)
                if not fixed_partitions:
                    moved = old.select(*keys, *[c for c in partition_cols if c not in keys]).join(
                        new.select(*keys).distinct(), list(keys), "left_semi")
                    parts = parts.unionByName(moved.select(*partition_cols))
                touched = parts.distinct().collect()
                old = old.where(_any_of(touched, partition_cols))
            new = old.unionByName(new, allowMissingColumns=True)
        merged = keep_latest(new, keys, version)
        if partition_cols or old is None:
            if touched and not fixed_partitions:
                merged = materialized(merged)
                left = {tuple(r) for r in merged.select(*partition_cols).distinct().collect()}
            self.write_processed(merged, dataset, partition_cols)
            # A partition whose last key moved away has no rows to overwrite it with.
            for row in touched if not fixed_partitions else ():
                if tuple(row) not in left:
                    self._remove("/".join([self.path(dataset), *[f"{c}={row[c]}" for c in partition_cols]]))
            return
        # A flat dataset is read and replaced as a whole: stage it, swap it in, drop the copy.
        stage = f"{self.root}/staging/{dataset}"
        merged.write.mode("overwrite").parquet(stage)
        self.spark.read.parquet(stage).write.mode("overwrite").parquet(self.path(dataset))
        self._remove(stage)

    def high_water(self, dataset: str, ts: str) -> DataFrame:
        """One row with the newest instant, NULL for a dataset never written."""
        try:
            df = self.spark.read.parquet(self.path(dataset))
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([(None,)], "latest timestamp")
        return df.agg(F.max(ts).alias("latest"))

    def inventory(self, dataset: str, layer: str = "processed", source: str = "") -> DataFrame:
        """Files, bytes and rows of a dataset in one layer, from file metadata columns."""
        df = self.spark.read.parquet(self.path(dataset) if layer == "processed" else self.raw_path(source, dataset))
        per_file = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
            F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
        return per_file.agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))


def _any_of(rows, cols: Sequence[str]) -> Column:
    """Partition predicate for a short list of partition values."""
    pred = F.lit(False)
    for row in rows:
        one = F.lit(True)
        for c in cols:
            one = one & (F.col(c) == F.lit(row[c]))
        pred = pred | one
    return pred


def keep_latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last version per key by a partial aggregation, no sort of hot keys."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_r"))
    return latest.select(*keys, "_r.*").select(*df.columns)


def month_predicate(start: str, end: str, ts: str = "ts") -> Column:
    """Time bounds plus the year/month bounds that let the scan skip directories."""
    y0, m0, y1, m1 = int(start[:4]), int(start[5:7]), int(end[:4]), int(end[5:7])
    index = F.col("year") * 12 + F.col("month")
    return (F.col("year").between(y0, y1) & index.between(y0 * 12 + m0, y1 * 12 + m1)
            & F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def typed_and_stamped(df: DataFrame, ts: str, ingested_at: Column) -> DataFrame:
    return df.withColumns({
        ts: F.col(ts).cast("timestamp"), "ingested_at": ingested_at, "year": F.year(ts), "month": F.month(ts)})


def adjusted_prices(eod: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Adjusted columns under their plain names; rows with a gap are dropped."""
    out = eod if symbols is None else eod.where(F.col("symbol").isin(*symbols))
    return out.select("symbol", "ts", F.col("adjOpen").alias("open"), F.col("adjHigh").alias("high"),
                      F.col("adjLow").alias("low"), F.col("adjClose").alias("close"),
                      F.col("adjVolume").cast("double").alias("volume")).dropna()


def single_series(df: DataFrame, key: str, name: str, ts: str, value: str) -> DataFrame:
    """History of one series, the last value of each date."""
    return df.where(F.col(key) == name).groupBy(F.to_date(ts).alias("day")).agg(F.max_by(value, ts).alias(value))


def return_series(df: DataFrame, stamp: str, out: str = "ts") -> DataFrame:
    """Stamps with a zone's offset become instants in UTC without a zone; unreadable ones are dropped."""
    at = F.try_to_timestamp(F.col(stamp)) if df.schema[stamp].dataType.typeName() == "string" else F.col(stamp)
    return df.withColumn(out, at.cast("timestamp").cast("timestamp_ntz")).where(F.col(out).isNotNull()).drop(*[stamp] if stamp != out else [])


def discover_runs(metadata: DataFrame, returns: DataFrame) -> DataFrame:
    """Runs with metadata and returns that were not smoke runs."""
    return metadata.where("smoke IS NOT TRUE").join(returns.select("run").distinct(), "run", "left_semi")
