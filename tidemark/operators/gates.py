"""Decision rules over metric tables. Inputs are small (runs x regimes) and stay DataFrames."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import small_average_rank

# Fixed values of the pre-committed rules.
REQUIRED = ("qe_bull", "covid", "rate_cycle")
MIN_PASS, DM_ALPHA, BONFERRONI_ALPHA = 2, 0.05, 0.05 / 3
MIN_LIFT, MIN_FEATURES = 0.1, 3
RHO, RHO_ALPHA, REPRODUCTION_RHO = 0.5, 0.05, 0.9
MAX_RELATIVE_DELTA, UNEXPLAINED = 0.01, 1e-9
SIGN_FLIP_SHARE, SHARPE_SHIFT = 0.05, 0.10


def regime_comparison(metrics: DataFrame, variant: str, baseline: str, by: str = "run", regime: str = "regime") -> DataFrame:
    """One row per regime: both Sharpes and whether the variant wins."""
    pick = lambda name: F.max(F.when(F.col(by) == name, F.col("sharpe")))
    out = metrics.where(F.col(by).isin(variant, baseline)).groupBy(regime).agg(
        pick(variant).alias("variant_sharpe"), pick(baseline).alias("baseline_sharpe"))
    return out.withColumn("beats", F.coalesce(F.col("variant_sharpe") > F.col("baseline_sharpe"), F.lit(False)))


def regime_gate(comparison: DataFrame, dm: DataFrame | None, required: Sequence[str] = REQUIRED, min_pass: int = MIN_PASS,
                alpha: float = DM_ALPHA, regime: str = "regime") -> DataFrame:
    """Wins in enough required regimes and one significant loss difference.

    Without ``dm`` only the Sharpe half is judged (arms whose errors cannot be compared).
    """
    need = comparison.where(F.col(regime).isin(*required))
    if dm is None:
        out = need.agg(F.count_if("beats").alias("pass_count"), F.lit(None).cast("bigint").alias("significant_count"))
        return out.withColumn("gate_passed", F.col("pass_count") >= min_pass)
    joined = need.join(dm.select(regime, "p_value"), regime, "left")
    out = joined.agg(F.count_if("beats").alias("pass_count"), F.count_if(F.col("p_value") < alpha).alias("significant_count"))
    return out.withColumn("gate_passed", (F.col("pass_count") >= min_pass) & (F.col("significant_count") >= 1))


def with_deflation(gate: DataFrame, dsr: DataFrame) -> DataFrame:
    """The gate and a deflated Sharpe that passed: two one-row tables on a constant key."""
    d = dsr.select(F.lit(1).alias("_k"), "dsr", F.col("passed").alias("dsr_passed"))
    out = gate.withColumnRenamed("gate_passed", "regime_passed").withColumn("_k", F.lit(1)).join(d, "_k").drop("_k")
    return out.withColumn("gate_passed", F.col("regime_passed") & F.col("dsr_passed"))


def criterion_value(kind: Column, variant: Column, baseline: Column) -> Column:
    """Absolute delta or relative reduction; NULL when it cannot be formed."""
    return F.when(kind == "delta_higher", variant - baseline).when(
        kind == "rel_reduction", F.try_divide(baseline - variant, baseline))


def judged(criteria: DataFrame) -> DataFrame:
    """Adds value and met to (target, regime, metric, kind, threshold, variant, baseline)."""
    value = criterion_value(F.col("kind"), F.col("variant"), F.col("baseline"))
    out = criteria.withColumn("value", value)
    return out.withColumn("met", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def target_gate(criteria: DataFrame, ci: DataFrame, deflation: DataFrame, required: Sequence[str] = REQUIRED,
                min_pass: int = MIN_PASS) -> DataFrame:
    """Per target: every criterion met in enough regimes, an interval off zero, deflation passed."""
    per_regime = judged(criteria).where(F.col("regime").isin(*required)).groupBy("target", "regime").agg(F.bool_and("met").alias("material"))
    sig = ci.withColumn("off_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)).select("target", "regime", "off_zero")
    both = per_regime.join(sig, ["target", "regime"], "left").groupBy("target").agg(
        F.count_if("material").alias("material_pass_count"), F.coalesce(F.bool_or("off_zero"), F.lit(False)).alias("significance_passed"))
    out = both.join(deflation.select("target", F.col("passed").alias("deflation_passed")), "target")
    out = out.withColumn("materiality_passed", F.col("material_pass_count") >= min_pass)
    return out.withColumn("gate_passed", F.col("materiality_passed") & F.col("significance_passed") & F.col("deflation_passed"))


def carry_forward(criteria: DataFrame) -> DataFrame:
    """Targets material in at least one regime, with the regimes."""
    per = judged(criteria).groupBy("target", "regime").agg(F.bool_and("met").alias("material")).where("material")
    return per.groupBy("target").agg(F.array_sort(F.collect_list("regime")).alias("regimes"))


def materiality_margins(criteria: DataFrame) -> DataFrame:
    """Smallest value / threshold per target and regime, and the summed average ranks."""
    j = judged(criteria).withColumn("_m", F.try_divide("value", "threshold"))
    per = j.groupBy("target", "regime").agg(
        F.when(F.count("_m") == F.count(F.lit(1)), F.min("_m")).alias("margin"))
    ranked = per.withColumn("rank", small_average_rank(F.col("margin"), "regime"))
    return ranked.withColumn("borda_total", F.sum("rank").over(Window.partitionBy("target")))


def qualifying_features(lifts: DataFrame, ci: DataFrame, min_lift: float = MIN_LIFT, noise_guard: bool = True) -> DataFrame:
    """Per feature set its best regime by lift that passes lift and noise rules."""
    per_set = Window.partitionBy("set_name")
    rows = lifts.withColumn("sign_consistent", F.count_if(F.col("lift") > 0).over(per_set) >= 2)
    rows = rows.join(ci.select("set_name", "regime", "ci_low", "ci_high"), ["set_name", "regime"], "left")
    off_zero = F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))
    ok = F.col("lift") >= min_lift
    if noise_guard:
        ok = ok & (off_zero | F.col("sign_consistent"))
    first = F.row_number().over(per_set.orderBy(F.col("lift").desc(), "regime"))
    return rows.where(ok).withColumn("_r", first).where("_r = 1").drop("_r")


def feature_gate(lifts: DataFrame, ci: DataFrame, min_features: int = MIN_FEATURES, **kw) -> DataFrame:
    q = qualifying_features(lifts, ci, **kw).agg(F.count(F.lit(1)).alias("n_qualifying")).withColumn("_k", F.lit(1))
    n = lifts.agg(F.countDistinct("set_name").alias("n_candidates")).withColumn("_k", F.lit(1))
    return q.join(n, "_k").drop("_k").withColumn("gate_passed", F.col("n_qualifying") >= min_features)


def attribution_gate(agreement: DataFrame, reproduction: DataFrame | None = None) -> DataFrame:
    """Rank agreement is strong, significant, and the reference signal was reproduced."""
    out = agreement.withColumns({"materiality_passed": F.col("rho") >= RHO, "significance_passed": F.col("p_value") < RHO_ALPHA})
    if reproduction is None:
        return out.withColumns({"reproduction_rho": F.lit(None).cast("double"), "gate_passed": F.lit(False)})
    r = reproduction.select(F.lit(1).alias("_k"), F.col("rho").alias("reproduction_rho"))
    out = out.withColumn("_k", F.lit(1)).join(r, "_k").drop("_k")
    return out.withColumn("gate_passed", F.col("materiality_passed") & F.col("significance_passed")
                          & F.coalesce(F.col("reproduction_rho") >= REPRODUCTION_RHO, F.lit(False)))


def attribution_status(ablation: Column, permutation: Column, gate_passed: Column) -> Column:
    """Which evidence backs a feature."""
    a = F.when(F.isnan(ablation) | (F.abs(ablation) == float("inf")), None).otherwise(ablation)
    p = F.when(F.isnan(permutation) | (F.abs(permutation) == float("inf")), None).otherwise(permutation)
    return (F.when(a.isNotNull() & p.isNotNull() & gate_passed & (F.signum(a) == F.signum(p)), "agreed")
            .when(a.isNotNull() & p.isNotNull(), "both").when(a.isNotNull(), "ablation_only")
            .when(p.isNotNull(), "oos_permutation").otherwise("none"))


def signal_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], col: str = "signal") -> DataFrame:
    j = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), list(keys))
    out = j.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_mismatches"))
    return out.withColumn("passed", (F.col("n_checks") > 0) & (F.col("n_mismatches") == 0))


def sizing_reconciliation(a: DataFrame, b: DataFrame, limit: float = MAX_RELATIVE_DELTA) -> DataFrame:
    """Notional of one sizing against another per symbol."""
    j = a.select("symbol", F.col("notional").alias("a_notional")).join(b.select("symbol", F.col("notional").alias("b_notional")), "symbol")
    out = j.withColumn("relative_delta", F.try_divide("b_notional", "a_notional") - 1)
    return out.withColumn("passed", F.coalesce(F.abs("relative_delta") <= limit, F.lit(False)))


def leak_verdict(flip_share: Column, max_abs_shift: Column, changed_share: Column) -> Column:
    material = (flip_share > SIGN_FLIP_SHARE) | (max_abs_shift > SHARPE_SHIFT)
    return (F.when(material, "LEAK CONFIRMED + MATERIAL")
            .when((changed_share > 0) | (max_abs_shift != 0), "LEAK CONFIRMED + IMMATERIAL").otherwise("NO MECHANICAL SENSITIVITY"))


def exit_tests(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Named boolean tests of a wide one-row-per-run table, tall, with the count passed."""
    filled = rows.withColumns({f"t_{n}": F.coalesce(c, F.lit(False)) for n, c in tests.items()})
    pairs = ", ".join(f"'{n}', `t_{n}`" for n in tests)
    tall = filled.select("run", F.expr(f"stack({len(tests)}, {pairs}) AS (test, passed)"))
    return tall.withColumn("n_passed", F.count_if("passed").over(Window.partitionBy("run")))
