"""Ranks and cumulative counts over sets too large for one task.

A plain ``rank() OVER (PARTITION BY day ORDER BY x)`` puts a whole cross-section
in one task. Here equal values are first collapsed (partial aggregation absorbs
hot values), the distinct values are cut into quantile buckets per group, each
bucket is ordered on its own, and bucket totals carry the offset. Exact.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.lake import materialized

#: Buckets of a group at least, and the distinct values of the largest group that one of them holds, on average.
BUCKETS, BUCKET_ROWS = 32, 100_000


def prefix_by_value(values: DataFrame, by: Sequence[str], x: str, measures: Sequence[str],
                    buckets: int = BUCKETS, rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``<m>_before`` (sum over smaller x) and ``<m>_total`` per group.

    ``values`` holds one row per (group, x). Groups are cut at approximate quantiles, so a
    task orders one bucket. Their number is a power of two, ``buckets`` at least, and grows with the
    largest group, so a bucket does not; the few edges per group are joined as Spark sees fit.
    """
    by = list(by)
    # Written: counted, cut and read again below.
    values = materialized(values)
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0  # one number
    depth = (max(buckets, -(-largest // rows)) - 1).bit_length()
    cuts = [i / 2 ** depth for i in range(1, 2 ** depth)]
    # Written: the edges of a large group depend on the order its parts are merged in, and rows and
    # bucket totals must see the same ones.
    edges = materialized(values.groupBy(*by).agg(F.percentile_approx(x, cuts, max(1000, 10 * 2 ** depth)).alias("_edges")))
    # Edges below x, by bisection; a column a step, since the next one reads it twice.
    bucketed = values.join(edges, by).withColumn("_b", F.lit(0))
    for k in reversed(range(depth)):
        bucketed = bucketed.withColumn("_b", F.col("_b") + F.when(F.get("_edges", F.col("_b") + (2 ** k - 1)) < F.col(x), 2 ** k).otherwise(0))
    bucketed = bucketed.drop("_edges")
    totals = bucketed.groupBy(*by, "_b").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_off") for m in measures],
        *[F.sum(f"_{m}").over(group).alias(f"{m}_total") for m in measures])
    inner = Window.partitionBy(*by, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.join(offsets, [*by, "_b"]).withColumns(
        {f"{m}_before": F.col(f"_{m}_off") + F.coalesce(F.sum(m).over(inner), F.lit(0)) for m in measures})
    return out.drop("_b", *[f"_{m}_off" for m in measures])


def average_rank(df: DataFrame, by: Sequence[str], x: str, buckets: int = BUCKETS) -> DataFrame:
    """Distinct (group, x) rows with average-tie ``rank`` and ``n``; NULL x has no rank."""
    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_cnt"))
    out = prefix_by_value(values, by, x, ["_cnt"], buckets)
    return out.select(*by, x, (F.col("_cnt_before") + (F.col("_cnt") + 1) / 2).alias("rank"),
                      F.col("_cnt_total").alias("n"))


def competition_rank(df: DataFrame, by: Sequence[str], x: str, out: str = "rank") -> DataFrame:
    """Descending 1-2-2-4 rank of every row in its group, NULLs last; any group size."""
    # Written: a value computed again may differ in its last bit, and would then not find its rank.
    df = materialized(df)
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_cnt"))
    known = prefix_by_value(counts.where(F.col(x).isNotNull()), by, x, ["_cnt"])
    ranked = known.select(*by, x, (F.col("_cnt_total") - F.col("_cnt_before") - F.col("_cnt") + 1).cast("bigint").alias("_r"))
    sizes = counts.where(F.col(x).isNotNull()).groupBy(*by).agg(F.sum("_cnt").alias("_n"))
    joined = df.join(ranked, [*by, x], "left").join(sizes, list(by), "left")
    return joined.withColumn(out, F.coalesce("_r", F.coalesce("_n", F.lit(0)) + 1)).drop("_r", "_n")


def small_average_rank(x: Column, *by: str, ascending: bool = True) -> Column:
    """Average-tie rank as a window, for groups of declared size (features, runs)."""
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2


def importance_ranks(rows: DataFrame, columns: Sequence[str], y: str, key: str = "symbol") -> DataFrame:
    """key, feature, importance (rows where the column's sign is that of ``y``), rank.

    One aggregation over all columns; ranks descend with averaged ties inside the few rows of a key.
    """
    counts = rows.groupBy(key).agg(*[F.count_if(F.signum(c) == F.signum(y)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    tall = counts.select(key, F.expr(f"stack({len(columns)}, {pairs}) AS (feature, importance)"))
    return tall.withColumn("rank", small_average_rank(F.col("importance"), key, ascending=False))


#: Rows of a cross-section from which on it is cut, and into how many pieces at most.
CROWDED, PIECES = 200_000, 64


def percent_rank_columns(df: DataFrame, columns: Sequence[str], day: str = "ts", key: str = "symbol",
                         min_symbols: int = 5, prefix: str = "xs_rank_", crowded: int = CROWDED, rows: DataFrame | None = None) -> DataFrame:
    """Percentile rank of each column across all symbols of a day, average ties.

    NULL inputs get NULL; days with fewer than ``min_symbols`` values get NULL. Rows carry their
    ranks: one window per column, no join back. The cross-sections of all columns are measured
    in one aggregation; one with more than ``crowded`` values is cut at its quantiles, and a
    value that fills several pieces becomes a piece of its own, whose rows, being ties, are dealt
    over tasks. Counts of earlier pieces are added. The lists of crowded days and of their
    pieces are written, so that their sizes are known when they are joined.

    ``rows``, a table with the same days as often and cheaper to read, tells that no day has so many rows
    without computing the columns once more.
    """
    cuts = [i / PIECES for i in range(1, PIECES)]
    crowd = rows is None or not rows.groupBy(day).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded).isEmpty()
    same = F.col(day).eqNullSafe(F.col("_day"))
    if crowd:
        sizes = df.groupBy(F.col(day).alias("_day")).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)])
        hot = materialized(sizes.where(F.greatest(F.lit(0), *[F.col(f"_n{i}") for i in range(len(columns))]) > crowded))
        crowd = not hot.isEmpty()
    if crowd:
        hot = materialized(df.join(hot, same).groupBy(*hot.columns).agg(
            *[F.percentile_approx(c, cuts, 10_000).alias(f"_q{i}") for i, c in enumerate(columns)]))
        out = df.join(hot, same, "left").drop("_day")
    else:
        out = df.withColumns({f"_n{i}": F.lit(0) for i in range(len(columns))} | {
            f"_q{i}": F.lit(None).cast("array<double>") for i in range(len(columns))})
    names = {}
    for i, c in enumerate(columns):
        edges = F.when(F.col(f"_n{i}") > crowded, F.array_distinct(f"_q{i}"))
        often = F.size(F.filter(f"_q{i}", lambda e: e == F.col(c)))
        piece = F.when(F.col(c).isNotNull(), 2 * F.size(F.filter(edges, lambda e: e < F.col(c))) + F.when(often > 1, 1).otherwise(0))
        names |= {f"_p{i}": F.when(edges.isNotNull(), piece), f"_m{i}": F.when(edges.isNotNull(), F.greatest(often, F.lit(1))).otherwise(1)}
    out = out.withColumns(names).drop(*[f"_q{i}" for i in range(len(columns))])
    for i, c in enumerate(columns):
        p = f"_p{i}"
        if crowd:
            pieces = out.where(F.col(p).isNotNull()).groupBy(F.col(day).alias("_day"), F.col(p).alias("_piece")).agg(F.count(F.lit(1)).alias("_in"))
            before = Window.partitionBy("_day").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
            pieces = materialized(pieces.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))))
            out = out.join(pieces, F.col(day).eqNullSafe(F.col("_day")) & (F.col(p) == F.col("_piece")), "left").drop("_day", "_piece")
        else:
            out = out.withColumns({"_in": F.lit(None).cast("bigint"), "_before": F.lit(None).cast("bigint")})
        spread = F.when(F.col(c).isNull(), PIECES).otherwise(F.col(f"_m{i}"))
        # Only rows that need no window of their whole day are dealt: ties of one piece, and NULLs of a cut day.
        out = out.withColumn("_copy", F.when(F.col(f"_n{i}") > crowded, F.pmod(F.xxhash64(key), spread)).otherwise(0))
        group = Window.partitionBy(day, p, "_copy") if crowd else Window.partitionBy(day)
        line = group.orderBy(F.col(c).asc_nulls_last())
        here, own = F.rank().over(line), F.count(c).over(line.rangeBetween(0, 0))
        alone = F.col(p) % 2 == 1
        ties = F.when(alone, F.col("_in")).otherwise(own)
        n = F.when(F.col(f"_n{i}") > crowded, F.col(f"_n{i}")).otherwise(F.count(c).over(group))
        rank = F.coalesce("_before", F.lit(0)) + here + (ties - 1) / 2
        out = out.withColumn(prefix + c, F.when(F.col(c).isNotNull() & (n >= min_symbols), rank / n)).drop("_in", "_before", "_copy")
    return out.select(*df.columns, *[prefix + c for c in columns])


def roc_auc(pred: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rank-sum ROC-AUC per group; NULL when a group has a single class."""
    values = pred.where(f"{y} IS NOT NULL AND {p} IS NOT NULL").groupBy(*by, p).agg(
        F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) > 0, 0).otherwise(1)).alias("neg"))
    pre = prefix_by_value(values, by, p, ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    n1, n0 = F.max("pos_total"), F.max("neg_total")
    return pre.groupBy(*by).agg(
        F.try_divide(wins, n1.cast("double") * n0).alias("auc"), (n1 + n0).alias("n"))


def spearman(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two columns over complete pairs, NULL below three pairs."""
    complete = pairs.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").groupBy(*by, a, b).agg(
        F.count(F.lit(1)).alias("w"))
    complete = materialized(complete)
    ranked = complete
    for side in (a, b):
        vals = complete.groupBy(*by, side).agg(F.sum("w").alias("_cnt"))
        r = prefix_by_value(vals, by, side, ["_cnt"]).select(
            *by, side, (F.col("_cnt_before") + (F.col("_cnt") + 1) / 2).alias(f"r_{side}"))
        ranked = ranked.join(r, [*by, side])
    ra, rb, w = F.col(f"r_{a}"), F.col(f"r_{b}"), F.col("w").cast("double")
    n = F.sum(w)
    # Ranks of n values always average (n + 1) / 2, ties included.
    m = (n + 1) / 2
    cov = F.sum(w * ra * rb) - n * m * m
    va, vb = F.sum(w * ra * ra) - n * m * m, F.sum(w * rb * rb) - n * m * m
    rho = F.when(n >= 3, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    return ranked.groupBy(*by).agg(rho.alias("rho"), n.cast("bigint").alias("n"))


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, cuts: Sequence[float], out: str = "q") -> DataFrame:
    """Linearly interpolated quantiles per group as an array, in the order of ``cuts``.

    The order statistics are found among distinct values with their cumulative
    counts, so no task holds a whole group.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_cnt"))
    pre = prefix_by_value(values, by, x, ["_cnt"])
    first, last, top = F.col("_cnt_before"), F.col("_cnt_before") + F.col("_cnt") - 1, F.col("_cnt_total") - 1
    slots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(cuts)])
    low = lambda s: F.floor(s["q"] * top)
    touched = F.filter(slots, lambda s: (low(s) <= last) & (F.least(low(s) + 1, top) >= first))
    hits = pre.select(*by, x, first.alias("_f"), last.alias("_l"), top.alias("_top"), F.explode(touched).alias("_s"))
    lo = F.floor(F.col("_s.q") * F.col("_top"))
    hi, share = F.least(lo + 1, F.col("_top")), F.col("_s.q") * F.col("_top") - lo
    weight = (F.when(lo.between(F.col("_f"), F.col("_l")), 1 - share).otherwise(0.0)
              + F.when(hi.between(F.col("_f"), F.col("_l")), share).otherwise(0.0))
    single = hits.groupBy(*by, "_s.i").agg(F.sum(weight * F.col(x)).alias("_q"))
    return single.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_q"))), lambda s: s["_q"]).alias(out))
