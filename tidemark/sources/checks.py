"""Declared data checks: each rule set is one aggregate pass."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(*cols: str) -> dict[str, Column]:
    return {f"{c}_present": F.col(c).isNotNull() for c in cols}


def _positive(*cols: str) -> dict[str, Column]:
    return {f"{c}_positive": F.col(c) > 0 for c in cols}


def _calendar() -> dict[str, Column]:
    return {"year_range": F.col("year").between(1900, 2099), "month_range": F.col("month").between(1, 12)}


def rules(dataset: str) -> dict[str, Column]:
    """Rule name to the condition every row must meet."""
    if dataset == "bars":
        return {**_present("symbol", "ts", "open", "high", "low", "close", "volume", "ingested_at"),
                **_positive("open", "high", "low", "close"), "volume_not_negative": F.col("volume") >= 0, **_calendar()}
    if dataset == "eod":
        return {**_present("symbol", "ts", "open", "high", "low", "close", "volume", "adjOpen", "adjHigh", "adjLow",
                           "adjClose", "adjVolume", "divCash", "splitFactor", "ingested_at"),
                "volume_not_negative": F.col("volume") >= 0, "adjVolume_not_negative": F.col("adjVolume") >= 0,
                **_positive("splitFactor"), **_calendar()}
    if dataset == "macro":
        return _present("timestamp", "value", "series_id", "ingested_at")
    if dataset == "documents":
        return _present("document_id", "source", "symbol", "published_at", "ingested_at", "text")
    if dataset == "scored":
        shares = ("sentiment_positive", "sentiment_negative", "sentiment_neutral")
        return {**_present("document_id", "symbol", "published_at", "scored_at", "model_name", "model_version", *shares,
                           "sentiment_score"),
                **{f"{c}_unit": F.col(c).between(0.0, 1.0) for c in shares},
                "score_range": F.col("sentiment_score").between(-1.0, 1.0)}
    raise KeyError(dataset)


def type_violations(df: DataFrame, expected: Mapping[str, str], optional: Sequence[str] = ()) -> list[str]:
    """Missing or wrongly typed columns; extra columns are allowed."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in expected.items()
            if have.get(c) != t and not (c in optional and c not in have)]


def check(df: DataFrame, ruleset: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Tall report (rule, n_rows, n_violations); a NULL condition is a violation."""
    aggs = [F.count_if(~F.coalesce(cond, F.lit(False))).alias(f"v_{name}") for name, cond in ruleset.items()]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    pairs = ", ".join(f"'{n}', `v_{n}`" for n in ruleset)
    return wide.select(*by, "n_rows", F.expr(f"stack({len(ruleset)}, {pairs}) AS (rule, n_violations)"))


def require(df: DataFrame, ruleset: Mapping[str, Column]) -> None:
    """Raise when any rule is broken; the write path calls this before a write."""
    broken = [f"{r['rule']}: {r['n_violations']}" for r in check(df, ruleset).where("n_violations > 0").collect()]
    if broken:
        raise ValueError("data check failed: " + ", ".join(broken))


def bar_sanity(bars: DataFrame) -> DataFrame:
    bad = {"non_positive_close": F.col("close") <= 0, "high_below_low": F.col("high") < F.col("low"),
           "high_below_close": F.col("high") < F.col("close"), "low_above_close": F.col("low") > F.col("close"),
           "negative_volume": F.col("volume") < 0,
           "missing": F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()}
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in bad.items()])


def price_contract(bars: DataFrame, horizon: int) -> DataFrame:
    """Per symbol: whether labels with this horizon may be built."""
    c = F.col("close")
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull() | F.isnan(c)).alias("n_missing"),
                                     F.count_if(c == 0).alias("n_zero"))
    return out.withColumn("ok", (F.col("n_rows") > horizon) & (F.col("n_missing") == 0) & (F.col("n_zero") == 0))


def replay_contract(rows: DataFrame, signal: str = "signal") -> DataFrame:
    return check(rows, {"open_present": F.col("open").isNotNull(), "volume_present": F.col("volume").isNotNull(),
                        "signal_ternary": F.col(signal).isin(-1, 0, 1)})


def missing_rates(features: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Share of NULLs per symbol and column, flagged above ``limit``."""
    wide = features.groupBy("symbol").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    tall = wide.select("symbol", F.expr(f"stack({len(columns)}, {pairs}) AS (feature, missing_rate)"))
    return tall.withColumn("flagged", F.col("missing_rate") > limit)


def label_sanity(labels: DataFrame) -> DataFrame:
    y = F.col("y")
    out = labels.groupBy("label_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(y.isNull()).alias("n_missing"), F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.avg((y > 0).cast("double")).alias("positive_share"))
    return out.withColumn("balanced", F.col("positive_share").between(0.35, 0.65))


def point_in_time_audit(pairs: DataFrame) -> DataFrame:
    """Count of (document, bar) pairs where the document is not older than the bar."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                     F.count_if(F.col("published_at") >= F.col("bar_ts")).alias("n_violations"))


def look_ahead_gate(pairs: DataFrame, asof: str = "asof", seen: str = "bar_ts") -> DataFrame:
    out = pairs.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col(seen) > F.col(asof)).alias("n_violations"))
    return out.withColumn("passed", (F.col("n_violations") == 0) & (F.col("n_checks") > 0))


def parity_gate(batch: DataFrame, live: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-9,
                min_pairs: int = 250, min_regimes: int = 2, regime: str | None = None) -> DataFrame:
    """Cell-wise comparison of two feature tables; NULL equals NULL."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
        return df.select(*keys, *([regime] if regime and name == "a" else []),
                         F.expr(f"stack({len(columns)}, {pairs}) AS (feature, {name})"))

    j = tall(batch, "a").join(tall(live, "b"), [*keys, "feature"])
    diff = F.abs(F.col("a") - F.col("b"))
    scale = F.greatest(F.abs("a"), F.abs("b"))
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(diff <= rtol * scale, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n_cells"), F.count_if(~same).alias("n_mismatches"), F.max(diff).alias("max_abs_diff"),
            F.max(F.try_divide(diff, scale)).alias("max_rel_diff")]
    # Shared keys and regimes are reduced to distinct rows before they are counted.
    shared = batch.select(*keys, *([regime] if regime else [])).join(live.select(*keys).distinct(), list(keys), "left_semi")
    counts = shared.agg(F.count(F.lit(1)).alias("n_pairs"),
                        (F.countDistinct(regime) if regime else F.lit(min_regimes)).alias("n_regimes"))
    # Two one-row summaries, put side by side on a constant key.
    out = j.agg(*aggs).withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumn("passed", (F.col("n_mismatches") == 0) & (F.col("n_pairs") >= min_pairs)
                          & (F.col("n_regimes") >= min_regimes))


def one_sided_names(produced: DataFrame, registered: DataFrame, name: str = "name") -> DataFrame:
    """Names on one side only: drift between produced columns and their registry."""
    a = produced.select(name).distinct().withColumn("_p", F.lit(True))
    b = registered.select(name).distinct().withColumn("_r", F.lit(True))
    j = a.join(b, name, "full")
    return j.where("_p IS NULL OR _r IS NULL").select(
        name, F.when(F.col("_p").isNull(), "registered_only").otherwise("produced_only").alias("side"))


def catalog_integrity(catalog: DataFrame) -> DataFrame:
    """Duplicate names and references to names that do not exist."""
    dup = catalog.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(
        F.lit("duplicate").alias("issue"), "name", F.lit(None).cast("string").alias("ref"))
    refs = catalog.select("name", F.explode("depends_on").alias("ref")).distinct()
    names = catalog.select(F.col("name").alias("ref")).distinct()
    dangling = refs.join(names, "ref", "left_anti").select(F.lit("dangling").alias("issue"), "name", "ref")
    return dup.unionByName(dangling)


def registry_drift(registry: DataFrame, features: DataFrame, symbols: DataFrame, targets: Sequence[str],
                   models: Sequence[str], passed_ids: DataFrame, symbols_known: bool = True) -> DataFrame:
    """Unresolved references of strategy records, one row per violation."""
    def broken(refs: DataFrame, known: DataFrame, kind: str) -> DataFrame:
        return refs.join(known, "ref", "left_anti").select("id", F.lit(kind).alias("kind"), "ref")

    feature_refs = registry.select("id", F.explode("feature_set_ref").alias("ref")).distinct()
    symbol_refs = registry.select("id", F.explode("universe").alias("ref")).distinct()
    out = [broken(feature_refs, features.select(F.col("name").alias("ref")).distinct(), "feature"),
           registry.where(~F.col("target_ref").isin(*targets)).select("id", F.lit("target").alias("kind"), F.col("target_ref").alias("ref")),
           registry.where(~F.col("model_ref").isin(*models)).select("id", F.lit("model").alias("kind"), F.col("model_ref").alias("ref")),
           broken(registry.where("enabled").select("id", F.col("provenance").alias("ref")),
                  passed_ids.select(F.col("id").alias("ref")).distinct(), "provenance")]
    if symbols_known:
        out.append(broken(symbol_refs, symbols.select(F.col("symbol").alias("ref")).distinct(), "symbol"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def ledger_integrity(trials: DataFrame, group: str) -> DataFrame:
    """Per group: duplicate ids, starts out of file order, ends before starts, non-finite values.

    ``seq`` is the order of the file. Order is checked inside ``group`` (one agent or
    customer), whose rows are cut by ``seq`` blocks so that a hot group is spread.
    """
    from pyspark.sql import Window

    block = 4096
    dup = trials.groupBy(group, "id").agg(F.count(F.lit(1)).alias("k")).groupBy(group).agg(
        F.sum(F.when(F.col("k") > 1, F.col("k") - 1).otherwise(0)).alias("duplicate_ids"))
    blocked = trials.withColumn("_b", F.floor(F.col("seq") / block))
    inside = Window.partitionBy(group, "_b").orderBy("seq")
    steps = blocked.withColumn("_back", F.lag("started_at").over(inside) > F.col("started_at"))
    per_block = steps.groupBy(group, "_b").agg(
        F.count_if("_back").alias("back"), F.count_if(F.col("completed_at") < F.col("started_at")).alias("ended_early"),
        F.count_if(F.isnan("sharpe") | (F.abs("sharpe") == float("inf"))).alias("non_finite"),
        F.min_by("started_at", "seq").alias("first"), F.max_by("started_at", "seq").alias("last"))
    seam = F.lag("last").over(Window.partitionBy(group).orderBy("_b")) > F.col("first")
    merged = per_block.withColumn("back", F.col("back") + F.coalesce(seam, F.lit(False)).cast("int")).groupBy(group).agg(
        F.sum("back").alias("out_of_order"), F.sum("ended_early").alias("ended_early"), F.sum("non_finite").alias("non_finite"))
    return merged.join(dup, group)


def key_alignment(named: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of each table whose key another table lacks."""
    names = list(named)
    u = None
    for n, df in named.items():
        part = df.select(*keys).distinct().withColumn("_t", F.lit(n))
        u = part if u is None else u.unionByName(part)
    seen = u.groupBy(*keys).agg(*[F.max((F.col("_t") == n).cast("int")).alias(n) for n in names])
    return seen.agg(*[F.count_if((F.col(n) == 1) & (F.least(*[F.col(m) for m in names]) == 0)).alias(f"{n}_extra") for n in names])


def missing_set_columns(features: DataFrame, sets: Mapping[str, Sequence[str]], key: str = "symbol", least: int = 1) -> DataFrame:
    """(feature_set, key, feature, n_values) of every column that a set names and a symbol has fewer than
    ``least`` values in, before any fit starts. A column that the table lacks is missing for all symbols."""
    named = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    known = set(features.columns)
    counts = features.groupBy(key).agg(*[(F.count(c) if c in known else F.lit(0)).alias(c) for c in named])
    gaps = [F.when(F.col(c) < least, F.array(*[F.struct(F.lit(n).alias("feature_set"), F.lit(c).alias("feature"), F.col(c).cast("long").alias("n_values"))
                                               for n, cols in sets.items() if c in cols])) for c in named]
    return counts.select(key, F.inline(F.flatten(F.array_compact(F.array(*gaps))))).select("feature_set", key, "feature", "n_values")
