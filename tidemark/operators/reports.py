"""Report tables built from metric, trial and catalog tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import expected_max_sharpe


def histogram(df: DataFrame, by: Sequence[str], x: str, bins: int) -> DataFrame:
    """Equal-width counts per group, the last bin closed; two aggregate passes."""
    valid = df.where(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("_k", F.lit(1))
    keys = list(by) or ["_k"]
    span = valid.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    # The span has one row per group; without a group it is a single row.
    side = span if by else F.broadcast(span)
    binned = valid.join(side, keys).withColumn("bin", F.when(width > 0, F.least(
        F.floor((F.col(x) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("bigint"))
    return binned.groupBy(*keys, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "left": F.col("lo") + width * F.col("bin"), "right": F.col("lo") + width * (F.col("bin") + 1)}).drop("_k")


def mean_absolute_contribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Importance table of a contribution matrix, with each feature's share."""
    wide = df.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    tall = wide.select(F.expr(f"stack({len(columns)}, {pairs}) AS (feature, importance)"))
    return share_of_total(tall, [], "importance")


def share_of_total(scores: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return scores.withColumn("share", F.try_divide(F.col(x), F.sum(x).over(Window.partitionBy(*by))))


def scheme_by_regime(metrics: DataFrame, regimes: Sequence[str], run: str = "run", value: str = "sharpe") -> DataFrame:
    """Runs down, ``aggregate`` and regimes across."""
    return metrics.groupBy(run).pivot("regime", ["aggregate", *regimes]).agg(F.first(value))


def composite_ranking(metrics: DataFrame, run: str = "run", value: str = "sharpe", n_columns: int | None = None) -> DataFrame:
    """Mean of per-regime competition ranks (missing last) and its own rank."""
    from tidemark.operators.ranks import competition_rank

    ranked = competition_rank(metrics, ["regime"], value)
    mean = ranked.groupBy(run).agg(F.avg("rank").alias("mean_rank"))
    # Rank of the negated mean, so that the smallest mean comes first.
    out = competition_rank(mean.withColumns({"_k": F.lit(1), "_neg": -F.col("mean_rank")}), ["_k"], "_neg", "composite_rank")
    return out.drop("_k", "_neg")


def delta_to_baseline(metrics: DataFrame, baseline: str, run: str = "run", value: str = "sharpe") -> DataFrame:
    """Baseline rows absolute, every other run as the difference to it."""
    base = metrics.where(F.col(run) == baseline).select("regime", F.col(value).alias("_b"))
    out = metrics.join(base, "regime", "left")
    return out.withColumn("delta", F.when(F.col(run) == baseline, F.col(value)).otherwise(F.col(value) - F.col("_b"))).drop("_b")


def best_regime(deltas: DataFrame, run: str = "run") -> DataFrame:
    return deltas.groupBy(run).agg(F.max("delta").alias("best_delta"), F.max_by("regime", "delta").alias("best_regime"))


def sharpe_by_condition(returns: DataFrame, labels: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Sharpe under each (axis, condition)."""
    from tidemark.operators.metrics import sharpe

    return returns.join(labels, "ts").groupBy(*by, "axis", "condition").agg(sharpe("ret").alias("sharpe"), F.count("ret").alias("n_bars"))


def stress_windows(returns: DataFrame, windows: Sequence[tuple[str, str, str]], by: Sequence[str] = ("run",)) -> DataFrame:
    """Sharpe inside named date ranges, which may overlap."""
    from tidemark.operators.metrics import sharpe

    day = F.to_date("ts")
    hits = F.array_compact(F.array(*[F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in windows]))
    tagged = returns.withColumn("window", F.explode(hits))
    return tagged.groupBy(*by, "window").agg(sharpe("ret").alias("sharpe"), F.count("ret").alias("n_bars"))


def lineage(columns: Column) -> Column:
    """Data families a feature list draws on; every list rests on prices."""
    families = {"macro": ("DGS10", "DFF", "VIXCLS", "yield_curve", "vix_regime", "curve_inverted"),
                "documents": ("sentiment", "doc_count", "has_coverage"),
                "cross_section": ("xs_rank_",)}
    tags = [F.when(F.exists(columns, _matches("^(" + "|".join(prefixes) + ")")), F.lit(n)) for n, prefixes in families.items()]
    return F.array_compact(F.array(F.lit("prices"), *tags))


def run_span(returns: DataFrame, by: Sequence[str] = ("run",), regime: str = "regime") -> DataFrame:
    """What a run covers: first and last date, distinct dates, symbols and regimes."""
    return returns.groupBy(*by).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("ts").alias("n_dates"),
        F.count_distinct("symbol").alias("n_symbols"), F.count_distinct(regime).alias("n_regimes"))


def _matches(pattern: str):
    return lambda c: c.rlike(pattern)


def roster(metrics: DataFrame, verdicts: DataFrame, sparks: DataFrame) -> DataFrame:
    """Metrics with verdict and a down-sampled growth line per run."""
    return metrics.join(verdicts, "run", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown"))).join(sparks, "run", "left")


def spark_line(returns: DataFrame, n: int = 40) -> DataFrame:
    """Growth of 1 at ``n`` evenly spaced dates, as an array in time order."""
    from tidemark.operators.windows import compounded, downsample

    pts = downsample(returns.withColumn("_g", compounded("ret", "run")), n, "run")
    return pts.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "_g"))), lambda s: s["_g"]).alias("spark"))


def catalog_view(catalog: DataFrame, stats: DataFrame) -> DataFrame:
    return catalog.join(stats.withColumnRenamed("feature", "name"), "name", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unmeasured")))


def catalog_summary(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("n_features"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("stable", "drifting", "stale", "unmeasured")],
                    F.avg("coverage").alias("mean_coverage"))


def luck_bar(trials: DataFrame, by: Sequence[str], order: Sequence[str] = ("started_at", "id")) -> DataFrame:
    """Each trial with the best Sharpe that its number of trials would show by luck alone.

    Per group, in order: trials so far, spread of their Sharpes so far, the expected maximum of
    so many skill-less trials, the best Sharpe so far and whether it beats the bar. The bar is
    NULL, and not beaten, while there is no spread.
    """
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = F.nullif(F.col("sharpe"), F.lit(float("nan")))
    seen = trials.withColumns({"n_trials": F.sum("n_comparisons").over(line), "sharpe_std": F.stddev_samp(s).over(line), "best_sharpe": F.max(s).over(line)})
    bar = F.when(F.col("sharpe_std").isNotNull(), expected_max_sharpe(F.col("n_trials"), F.coalesce("sharpe_std", F.lit(0.0))))
    return seen.withColumn("luck_bar", bar).withColumn("beats_luck", F.coalesce(F.col("best_sharpe") > F.col("luck_bar"), F.lit(False)))


def trial_view(trials: DataFrame, by: Sequence[str] = (), sample: bool = True, min_trials: int = 2) -> DataFrame:
    """Deflation count, best Sharpe and dispersion, optionally per group."""
    s = F.nullif(F.col("sharpe"), F.lit(float("nan")))
    std = F.stddev_samp(s) if sample else F.stddev_pop(s)
    return trials.groupBy(*by).agg(F.sum("n_comparisons").alias("n_trials"), F.max(s).alias("best_sharpe"),
                                   F.when(F.count(s) >= min_trials, std).alias("sharpe_std"))


def with_commit(trials: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds the commit of the run with the same configuration, only if it is one."""
    from tidemark.functions.text import is_commit_id

    ids = runs.where(is_commit_id(F.col("git_sha"))).groupBy("config_hash").agg(F.min("git_sha").alias("commit"))
    return trials.join(ids, "config_hash", "left")


def append_trials(existing: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """New trials whose configuration is not recorded yet, with the next ids of the day.

    One row per new configuration is kept, the earliest. Ids follow the configuration
    hash; numbering is per hash bucket with bucket offsets, never one global sort.
    """
    first = new.groupBy("config_hash").agg(F.min_by(F.struct(*[c for c in new.columns if c != "config_hash"]), "started_at").alias("_r"))
    fresh = first.select("config_hash", "_r.*").join(existing.select("config_hash"), "config_hash", "left_anti")
    prefix = f"ledger-{day}-"
    last = existing.where(F.col("id").startswith(prefix)).agg(
        F.coalesce(F.max(F.regexp_extract("id", r"-(\d+)$", 1).cast("bigint")), F.lit(0)).alias("_last")).withColumn("_k", F.lit(1))
    bucketed = fresh.withColumns({"_b": F.substring("config_hash", 1, 3), "_k": F.lit(1)})
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("config_hash"))
    out = bucketed.withColumn("_p", place).join(offsets, "_b").join(last, "_k")
    number = F.col("_last") + F.col("_off") + F.col("_p")
    return out.withColumn("id", F.concat(F.lit(prefix), F.format_string("%04d", number))).drop("_b", "_k", "_p", "_off", "_last")


def allocation(registry: DataFrame) -> DataFrame:
    """Equal share of the book for each enabled strategy, 0 for idle ones."""
    on = F.col("enabled").cast("int")
    total = registry.agg(F.sum(on).alias("_n")).withColumn("_k", F.lit(1))
    out = registry.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")
    return out.withColumns({"allocation_pct": F.when(F.col("enabled"), F.try_divide(F.lit(100.0), F.col("_n"))).otherwise(0.0),
                            "state": F.when(F.col("enabled"), "enabled").otherwise("idle")}).drop("_n")


def fanout(roster_: DataFrame, detail: DataFrame, provenance: DataFrame, key: str = "run") -> DataFrame:
    """Which views exist for each run."""
    parts = [df.select(key).distinct().withColumn(n, F.lit(True)) for n, df in
             (("in_roster", roster_), ("in_detail", detail), ("in_provenance", provenance))]
    j = parts[0].join(parts[1], key, "full").join(parts[2], key, "full")
    flags = ["in_roster", "in_detail", "in_provenance"]
    j = j.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    return j.withColumn("complete", F.col(flags[0]) & F.col(flags[1]) & F.col(flags[2]))
