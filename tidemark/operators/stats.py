"""Forecast comparison tests, block bootstraps and deflated Sharpe ratios.

Inputs are series with at most one row per date and group. Resampling is a
sequence of blocks per replicate, drawn from hashes of (seed, replicate, block), so
results do not depend on partitioning and a lost task redraws the same blocks.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import expected_max_sharpe, norm_cdf, t_cdf
from tidemark.operators.metrics import sharpe
from tidemark.operators.ranks import roc_auc, small_average_rank
from tidemark.operators.windows import ANNUAL

DEFAULT_SHARPE_STD, DSR_THRESHOLD = 0.35, 0.5  # fixed values
_SPACE = float(1 << 48)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on its arguments."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(_SPACE)


# --- Diebold-Mariano ------------------------------------------------------------------------
def diebold_mariano(errors: DataFrame, by: Sequence[str], a: str = "err_a", b: str = "err_b", h: int = 1,
                    alternative: str = "less", correction: bool = True, ts: str = "ts",
                    p_values: bool = True) -> DataFrame:
    """Statistic and p-value per group; NULL under four bars or without variance.

    Newey-West variance with Bartlett weights on lags 1..h-1, small-sample
    correction, Student t with n - 1 degrees of freedom.
    """
    if h < 1:
        raise ValueError("h must be at least 1")
    if alternative not in ("less", "greater", "two-sided"):
        raise ValueError(f"unknown alternative {alternative!r}")
    by = list(by)
    group = Window.partitionBy(*by)
    d = errors.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").withColumn("_d", F.pow(a, 2) - F.pow(b, 2))
    d = d.withColumn("_m", F.avg("_d").over(group)).withColumn("_e", F.col("_d") - F.col("_m"))
    line = group.orderBy(ts)
    d = d.withColumns({f"_l{j}": F.col("_e") * F.lag("_e", j).over(line) for j in range(1, h)})
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"), F.max("_m").alias("_mean"), F.avg(F.col("_e") * F.col("_e")).alias("_g0"),
        *[F.avg(f"_l{j}").alias(f"_g{j}") for j in range(1, h)])
    spread = F.col("_g0")
    for j in range(1, h):
        spread = spread + 2 * (1 - j / h) * F.coalesce(f"_g{j}", F.lit(0.0))
    n = F.col("n_obs")
    var = spread / n
    stat = F.when((n >= 4) & (var > 0), F.col("_mean") / F.sqrt(F.greatest(var, F.lit(1e-300))))
    if correction:
        stat = stat * F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(0.0)))
    out = agg.select(*by, "n_obs", stat.alias("statistic"))
    if not p_values:
        return out
    s = F.col("statistic")
    cdf = (lambda x: t_cdf(x, (F.col("n_obs") - 1).cast("double"))) if correction else norm_cdf
    p = {"less": cdf(s), "greater": cdf(-s), "two-sided": 2 * cdf(-F.abs(s))}[alternative]
    return out.withColumn("p_value", p)


def regime_dm(errors: DataFrame, by: Sequence[str], regime: str = "regime", **kw) -> DataFrame:
    """The test inside each regime's own sequence of bars."""
    return diebold_mariano(errors, [*by, regime], **kw)


def dm_matrix(errors: DataFrame, scheme: str, order: Sequence[str], by: Sequence[str] = (), err: str = "err",
              ts: str = "ts", **kw) -> DataFrame:
    """All unordered pairs of schemes, in the declared order, on their common dates."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(scheme))
    keyed = errors.withColumn("_o", rank)
    left = keyed.select(*by, ts, F.col(scheme).alias("scheme_a"), F.col("_o").alias("_oa"), F.col(err).alias("err_a"))
    right = keyed.select(*by, ts, F.col(scheme).alias("scheme_b"), F.col("_o").alias("_ob"), F.col(err).alias("err_b"))
    pairs = left.join(right, [*by, ts]).where("_oa < _ob")
    return diebold_mariano(pairs, [*by, "scheme_a", "scheme_b"], **kw)


# --- bootstrap ------------------------------------------------------------------------------
#: Tasks that the replicates of one series are spread over.
SPREAD = 16


@dataclass(frozen=True)
class SumMetric:
    """A metric that follows from sums over a sample, so that a replicate needs no rows.

    ``terms(x, centre)`` are summed; ``value(n, sums, centre)`` is the metric. ``centre`` is the
    mean of the whole series: sums of squares around it lose no digits.
    """

    terms: Callable[[Column, Column], Sequence[Column]]
    value: Callable[[Column, Sequence[Column], Column], Column]


def _sharpe_of_sums(ddof: int) -> Callable[[Column, Sequence[Column], Column], Column]:
    def value(n: Column, sums: Sequence[Column], centre: Column) -> Column:
        mean = centre + sums[0] / n
        var = F.try_divide(sums[1] - sums[0] * sums[0] / n, n - ddof)
        # Of a constant sample rounding leaves about one part in 10^30 of the squared mean.
        return F.when(var > 1e-24 * mean * mean, mean / F.sqrt(F.greatest(var, F.lit(1e-300))) * math.sqrt(ANNUAL)).otherwise(0.0)

    return value


SHARPE = SumMetric(lambda x, c: [x - c, (x - c) * (x - c)], _sharpe_of_sums(1))
SHARPE_POPULATION = SumMetric(SHARPE.terms, _sharpe_of_sums(0))
MEAN_ABSOLUTE = SumMetric(lambda x, c: [F.abs(x)], lambda n, sums, c: sums[0] / n)


def _draws(n: Column, replicate: Column, block_len: int, seed: int, kind: str) -> Column:
    """Blocks of one replicate, in order: array of (start, len), together at least n long.

    ``stationary``: lengths are geometric with mean ``block_len``. So many blocks are drawn that
    a shortfall has no measurable chance; the last one takes whatever is left. ``moving``: fixed
    lengths. One hash a block names its start and its length.
    """
    mean = n / F.lit(float(block_len))
    many = F.ceil(mean) if kind == "moving" else F.ceil(mean + 12 * F.sqrt(mean) + 12)
    number = lambda h, at: F.conv(F.substring(h, at, 12), 16, 10).cast("bigint") / F.lit(_SPACE)
    starts = F.greatest(n - block_len, F.lit(1)) if kind == "moving" else n

    def block(b: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), b.cast("string")))
        length = F.lit(block_len) if kind == "moving" else 1 + F.floor(
            F.ln(1 - number(h, 13)) / F.lit(math.log(1 - 1.0 / block_len)))
        return F.struct(F.floor(number(h, 1) * starts).cast("bigint").alias("start"),
                        F.when(b == many - 1, n).otherwise(length).cast("bigint").alias("len"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), (many - 1).cast("bigint")), block)


def _replicates(groups: DataFrame, n_boot: int) -> DataFrame:
    """Every group once per replicate, dealt over tasks by ranges of replicates."""
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(min(SPREAD, n_boot) - 1)))).repartition(tasks)
    mine = F.sequence(F.col("_part") + 1, F.lit(n_boot), F.lit(min(SPREAD, n_boot)))
    return dealt.withColumn("replicate", F.explode(mine)).drop("_part")


def block_positions(series: DataFrame, by: Sequence[str], n_boot: int, block_len: int = 21, seed: int = 0,
                    kind: str = "stationary", ts: str = "ts") -> DataFrame:
    """(group, replicate, i, pos): resampled position for each place in the series.

    Stationary blocks wrap around the end of the series, moving ones stay inside it.
    """
    by = list(by)
    groups = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    drawn = _replicates(groups, n_boot).withColumn("_b", _draws(F.col("n"), F.col("replicate"), block_len, seed, kind))
    blocks = drawn.select(*by, "replicate", "n", F.posexplode("_b").alias("_k", "_d"))
    line = Window.partitionBy(*by, "replicate").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_at", F.coalesce(F.sum("_d.len").over(line), F.lit(0))).where("_at < n")
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_d.len"), F.col("n") - F.col("_at")) - 1)
    return placed.withColumn("_s", F.explode(steps)).select(
        *by, "replicate", (F.col("_at") + F.col("_s")).alias("i"), ((F.col("_d.start") + F.col("_s")) % F.col("n")).alias("pos"))


def resampled(series: DataFrame, by: Sequence[str], n_boot: int, ts: str = "ts", **kw) -> DataFrame:
    """The series' rows at the resampled positions, keyed by replicate."""
    by = list(by)
    placed = series.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(ts)) - 1)
    return block_positions(series, by, n_boot, ts=ts, **kw).join(placed, [*by, "pos"])


def resampled_sums(series: DataFrame, by: Sequence[str], columns: Sequence[str], metric: SumMetric, n_boot: int,
                   block_len: int = 21, seed: int = 0, kind: str = "stationary", ts: str = "ts") -> DataFrame:
    """(group, replicate, one metric per column) of the same draws as ``resampled``, without rows.

    A series, at most one row per date, becomes prefix sums in one row. A block is then the
    difference of two of them, so a replicate costs about n / block_len steps and no shuffle.
    """
    by = list(by)
    whole = Window.partitionBy(*by)
    line = whole.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    centred = series.withColumns({f"_c{k}": F.avg(c).over(whole) for k, c in enumerate(columns)})
    terms = [t for k, c in enumerate(columns) for t in metric.terms(F.col(c).cast("double"), F.col(f"_c{k}"))]
    each = len(terms) // len(columns)
    sums = centred.select(*by, F.row_number().over(line).alias("_i"), *[f"_c{k}" for k in range(len(columns))],
                          *[F.sum(t).over(line).alias(f"_p{k}") for k, t in enumerate(terms)])
    rows = F.array_sort(F.collect_list(F.struct("_i", *[f"_p{k}" for k in range(len(terms))])))
    groups = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rows.alias("_r"), *[F.max(f"_c{k}").alias(f"_c{k}") for k in range(len(columns))])
    groups = groups.select(*by, "n", *[f"_c{k}" for k in range(len(columns))], *[
        F.concat(F.array(F.lit(0.0)), F.col(f"_r._p{k}")).alias(f"_p{k}") for k in range(len(terms))])
    n = F.col("n")
    start_of = F.struct(F.lit(0).cast("bigint").alias("used"), *[F.lit(0.0).alias(f"s{k}") for k in range(len(terms))])

    def step(acc: Column, block: Column) -> Column:
        take = F.greatest(F.least(block["len"], n - acc["used"]), F.lit(0).cast("bigint"))
        end = (block["start"] + take).cast("int")
        first = block["start"].cast("int")

        def piece(k: int) -> Column:
            p = F.col(f"_p{k}")
            inside = F.get(p, F.least(end, n).cast("int")) - F.get(p, first)
            return acc[f"s{k}"] + inside + F.when(end > n, F.get(p, (end - n).cast("int"))).otherwise(0.0)

        return F.struct((acc["used"] + take).alias("used"), *[piece(k).alias(f"s{k}") for k in range(len(terms))])

    drawn = _replicates(groups, n_boot).withColumn(
        "_s", F.aggregate(_draws(n, F.col("replicate"), block_len, seed, kind), start_of, step))
    size = n.cast("double")
    return drawn.select(*by, "replicate", *[
        metric.value(size, [F.col(f"_s.s{k * each + j}") for j in range(each)], F.col(f"_c{k}")).alias(c)
        for k, c in enumerate(columns)])


def bootstrap_delta_ci(pairs: DataFrame, by: Sequence[str], metric: SumMetric | Callable[[str], Column] = SHARPE,
                       variant: str = "variant", baseline: str = "baseline", n_boot: int = 1000, ci: float = 0.90,
                       **kw) -> DataFrame:
    """Percentile interval of metric(variant) - metric(baseline), pairing kept.

    A ``SumMetric`` needs no resampled rows; any other metric builds an aggregate from a column
    name, and all replicates are one job. Replicates whose metric is undefined are left out.
    """
    if not 0 < ci < 1:
        raise ValueError("ci must be between 0 and 1")
    by = list(by)
    complete = pairs.where(f"{variant} IS NOT NULL AND {baseline} IS NOT NULL")
    if isinstance(metric, SumMetric):
        both = resampled_sums(complete, by, [variant, baseline], metric, n_boot, **kw)
        deltas = both.select(*by, "replicate", (F.col(variant) - F.col(baseline)).alias("delta"))
    else:
        deltas = resampled(complete, by, n_boot, **kw).groupBy(*by, "replicate").agg(
            (metric(variant) - metric(baseline)).alias("delta"))
    tail = (1 - ci) / 2
    valid = deltas.where(F.col("delta").isNotNull() & ~F.isnan("delta"))
    out = valid.groupBy(*by).agg(
        F.percentile("delta", tail).alias("ci_low"), F.percentile("delta", 1 - tail).alias("ci_high"),
        F.count(F.lit(1)).alias("n_replicates"))
    return out.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def bootstrap_auc_delta_ci(pairs: DataFrame, by: Sequence[str], n_boot: int = 1000, ci: float = 0.90, **kw) -> DataFrame:
    """The same for ROC-AUC of two scores against ``y_true``; single-class replicates drop out."""
    by = list(by)
    rows = resampled(pairs, by, n_boot, **kw)
    a = roc_auc(rows, [*by, "replicate"], p="variant").select(*by, "replicate", F.col("auc").alias("_a"))
    b = roc_auc(rows, [*by, "replicate"], p="baseline").select(*by, "replicate", F.col("auc").alias("_b"))
    deltas = a.join(b, [*by, "replicate"]).withColumn("delta", F.col("_a") - F.col("_b")).where("delta IS NOT NULL")
    tail = (1 - ci) / 2
    return deltas.groupBy(*by).agg(F.percentile("delta", tail).alias("ci_low"), F.percentile("delta", 1 - tail).alias("ci_high"),
                                   F.count(F.lit(1)).alias("n_replicates"))


def moving_block_sharpe_ci(returns: DataFrame, by: Sequence[str], n_boot: int = 2000, ci: float = 0.95,
                           block_len: int = 21, seed: int = 42) -> DataFrame:
    """Interval of the Sharpe ratio with the population's deviation, over blocks of fixed length."""
    by = list(by)
    per_rep = resampled_sums(returns.where("ret IS NOT NULL"), by, ["ret"], SHARPE_POPULATION, n_boot,
                             block_len=block_len, seed=seed, kind="moving")
    tail = (1 - ci) / 2
    return per_rep.groupBy(*by).agg(F.percentile("ret", tail).alias("ci_low"), F.percentile("ret", 1 - tail).alias("ci_high"))


# --- deflation ------------------------------------------------------------------------------
def moments(returns: DataFrame, by: Sequence[str], ret: str = "ret") -> DataFrame:
    """n, annual Sharpe, bias-corrected skew and excess kurtosis (0 where undefined)."""
    n = F.count(ret).cast("double")
    g1, g2 = F.skewness(ret), F.kurtosis(ret)
    spread = F.coalesce(F.stddev_samp(ret), F.lit(0.0)) > 0
    skew = F.when(spread & (n > 2), g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(0.0)
    kurt = F.when(spread & (n > 3), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)).otherwise(0.0)
    return returns.groupBy(*by).agg(
        F.count(ret).alias("n_obs"), sharpe(ret).alias("sr_observed"), skew.alias("skew"),
        kurt.alias("excess_kurtosis"), g1.alias("skew_pop"), g2.alias("kurtosis_pop"))


def deflated_sharpe(returns: DataFrame, by: Sequence[str], n_trials: Column | int, sharpe_std: Column | float = DEFAULT_SHARPE_STD,
                    threshold: float = DSR_THRESHOLD, ann: int = ANNUAL) -> DataFrame:
    """Chance that the true Sharpe exceeds the expected best of ``n_trials`` skill-less ones."""
    trials = F.lit(n_trials) if isinstance(n_trials, int) else n_trials
    std = F.lit(float(sharpe_std)) if isinstance(sharpe_std, (int, float)) else sharpe_std
    m = moments(returns, by).where("n_obs >= 2").withColumn("sr_benchmark", expected_max_sharpe(trials, std))
    sr, sr0 = F.col("sr_observed") / math.sqrt(ann), F.col("sr_benchmark") / math.sqrt(ann)
    kurt = F.col("excess_kurtosis") + 3
    var = F.greatest(1 - F.col("skew") * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12))
    z = (sr - sr0) * F.sqrt(F.col("n_obs") - 1) / F.sqrt(var)
    return m.withColumn("z", z).withColumn("dsr", norm_cdf(F.col("z"))).withColumn("passed", F.col("dsr") > threshold)


def mertens_deflation(returns: DataFrame, by: Sequence[str], n_trials: int, ann: int = ANNUAL) -> DataFrame:
    """Earlier variant: the benchmark scales with the Sharpe's own standard error."""
    m = moments(returns, by)
    sr = F.col("sr_observed") / math.sqrt(ann)
    se = F.sqrt((1 + 0.5 * sr * sr - F.col("skew_pop") * sr + F.col("kurtosis_pop") / 4 * sr * sr) / F.col("n_obs"))
    m = m.withColumn("se", se).withColumn("benchmark", expected_max_sharpe(F.lit(n_trials), F.col("se")))
    z = F.try_divide(sr - F.col("benchmark"), F.col("se"))
    return m.withColumn("dsr", F.coalesce(norm_cdf(z), F.lit(0.5)))


def skill_z(skill: DataFrame, by: Sequence[str], x: str = "skill", threshold: float = 0.0) -> DataFrame:
    """Mean over standard error; without spread the limit by the sign of the mean."""
    v = skill.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    agg = v.groupBy(*by).agg(F.count(x).alias("n_obs"), F.avg(x).alias("mean_skill"),
                             F.stddev_samp(x).alias("_sd"), (F.max(x) - F.min(x)).alias("_range")).where("n_obs >= 2")
    flat = F.col("_range") == 0
    se = F.when(flat, 0.0).otherwise(F.col("_sd") / F.sqrt("n_obs"))
    m = F.col("mean_skill")
    limit = F.when(m > threshold, float("inf")).when(m < threshold, float("-inf")).otherwise(0.0)
    z = F.when(flat, limit).otherwise(F.try_divide(m, se))
    return agg.select(*by, "n_obs", "mean_skill", se.alias("se_skill"), z.alias("z")).withColumn("passed", F.col("z") > threshold)


# --- rank agreement -------------------------------------------------------------------------
def rank_agreement(scores: DataFrame, by: Sequence[str], a: str, b: str, n_permutations: int = 10_000,
                   seed: int = 0) -> DataFrame:
    """Spearman's rho of two score columns and its upper-tail permutation p-value.

    Groups are small declared sets (feature names): their ranks are one row of arrays. A
    permutation orders the first side's ranks by hashes of (seed, replicate, feature) and is
    one expression; ranges of replicates are dealt over tasks, and every task returns a count.
    NULL where there are fewer than three features or one side has a single value.
    """
    by = list(by)
    r = scores.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").select(
        *by, "feature", small_average_rank(F.col(a), *by).alias("ra"), small_average_rank(F.col(b), *by).alias("rb"))
    listed = F.array_sort(F.collect_list(F.struct("feature", "ra", "rb")))
    groups = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), listed.alias("_f")).where("n > 0")
    # Ranks of n values average (n + 1) / 2, whatever the ties; a permutation keeps both spreads.
    mean = (F.col("n") + 1) / 2.0
    spread = lambda x: F.aggregate("_f", F.lit(0.0), lambda s, f: s + (f[x] - mean) * (f[x] - mean))
    product = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - mean) * (p["y"] - mean))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    scale = F.sqrt(spread("ra")) * F.sqrt(spread("rb"))
    groups = groups.withColumn("_scale", scale).withColumn(
        "rho", F.try_divide(product(F.transform("_f", lambda f: pair(f["ra"], f["rb"]))), F.col("_scale")))
    key = lambda f: uniform(F.lit(seed), F.col("replicate"), f["feature"])
    order = F.array_sort(F.transform("_f", lambda f: F.struct(key(f).alias("u"), f["feature"].alias("feature"), f["ra"].alias("ra"))))
    permuted = F.try_divide(product(F.zip_with(order, "_f", lambda o, f: pair(o["ra"], f["rb"]))), F.col("_scale"))
    drawn = _replicates(groups, n_permutations).withColumn("_hit", permuted >= F.col("rho") - 1e-12)
    counted = drawn.groupBy(*by).agg(F.max("rho").alias("rho"), F.max("n").alias("n"), F.count_if("_hit").alias("_k"))
    return counted.where("n IS NOT NULL").select(
        *by, F.when(F.col("n") >= 3, F.col("rho")).alias("rho"), "n", ((1 + F.col("_k")) / F.lit(1.0 + n_permutations)).alias("p_value"))


def poisson_draw(*parts: Column) -> Column:
    """``poisson_weight`` of ``uniform(*parts)``, told from the hash's digits: as fixed-width text they order like the number."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)
    bounds, cum = [], 0.0
    while cum + (step := math.exp(-1.0) / math.factorial(len(bounds))) > cum:
        cum += step
        bounds.append(math.ceil(cum * _SPACE))
    out = F.when(digits < f"{bounds[0]:012x}", 0)
    for k, bound in enumerate(bounds[1:], 1):
        if bound < _SPACE:  # no draw reaches the others
            out = out.when(digits < f"{bound:012x}", k)
    return out.otherwise(sum(b < _SPACE for b in bounds))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform number, by inversion to the end of double precision."""
    total, cum, k = F.lit(0), 0.0, 0
    while cum + (step := math.exp(-1.0) / math.factorial(k)) > cum:
        cum, k = cum + step, k + 1
        total = total + F.when(u >= cum, 1).otherwise(0)
    return total
