"""Signals to target positions, sizes, net targets and order deltas, all as tables."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAPER_SLIPPAGE_BPS = 5.0  # fixed values
SIM_LIQUIDITY_CAP = 0.10
QTY_EPS = 1e-9


def target_position(forecast: Column | str) -> Column:
    f = F.col(forecast) if isinstance(forecast, str) else forecast
    usable = F.when(F.isnan(f) | (F.abs(f) == float("inf")), None).otherwise(f)
    return F.coalesce(F.signum(usable), F.lit(0.0)).cast("int")


def fill_price(price: Column, target: Column, slippage_bps: float) -> Column:
    return price * (1 + F.signum(target.cast("double")) * slippage_bps / 10_000)


def whole_shares(capital: Column, price: Column) -> Column:
    ok = (price > 0) & ~F.isnan(price) & (price < float("inf"))
    return F.when(ok, (capital / F.nullif(price, F.lit(0.0))).cast("bigint")).otherwise(0)


def size_equal_weight(universe: DataFrame, signals: DataFrame, prices: DataFrame, slippage_bps: float = PAPER_SLIPPAGE_BPS) -> DataFrame:
    """Whole shares per (strategy, symbol): budget over the full universe, signed.

    ``universe`` has (strategy, symbol, budget, n_symbols); symbols lacking a signal or
    a price are left out, flat ones keep a zero size.
    """
    j = universe.join(signals.select("symbol", "target"), "symbol").join(prices.select("symbol", "price"), "symbol")
    fill = fill_price(F.col("price"), F.col("target"), slippage_bps)
    live = (F.col("target") != 0) & (F.col("price") > 0)
    shares = F.when(live, F.col("target") * whole_shares(F.col("budget") / F.col("n_symbols"), fill)).otherwise(0).cast("double")
    return j.withColumns({"shares": shares, "notional": shares * fill})


def cash_fraction_shares(cash: Column, price: Column, target: Column, volume: Column | None = None, slippage_bps: float = 5.0,
                         cap: float = SIM_LIQUIDITY_CAP) -> Column:
    """Shares the replay would open with this cash."""
    most = whole_shares(cash, fill_price(price, target, slippage_bps))
    if volume is not None:
        most = F.least(most, (volume * cap).cast("bigint"))
    return F.when((target == 0) | (cash <= 0) | (price <= 0), 0).otherwise(F.greatest(F.lit(0), most)).cast("bigint")


def net_targets(sized: DataFrame) -> DataFrame:
    """One net target per symbol over all strategies.

    Direction is the sign of the budget-weighted votes; the size is the summed signed
    shares; the tightest cap below one unit forbids the position.
    """
    agg = sized.groupBy("symbol").agg(
        F.signum(F.sum(F.col("weight") * F.col("target"))).cast("int").alias("_d"), F.sum("shares").alias("_s"),
        F.sum("notional").alias("_n"), F.min("max_position").alias("_cap"))
    kept = F.when(F.abs("_d") <= F.col("_cap"), F.col("_d")).otherwise(0)
    out = agg.withColumn("target", kept.cast("int"))
    live = F.col("target") != 0
    return out.select("symbol", "target", F.when(live, F.abs("_s")).otherwise(0.0).alias("shares"),
                      F.when(live, F.col("_n")).otherwise(0.0).alias("notional"))


@dataclass(frozen=True)
class Cycle:
    """Where a daily cycle gets its inputs from, as callables of the as-of instant.

    ``signal`` gives (symbol, target), ``price`` (symbol, price), and ``capital`` the universe
    with each strategy's ``budget``.
    """

    signal: Callable[[str], DataFrame]
    price: Callable[[str], DataFrame]
    capital: Callable[[DataFrame, str], DataFrame]


def run_cycle(universe: DataFrame, cycle: Cycle, asof: str, slippage_bps: float = PAPER_SLIPPAGE_BPS) -> DataFrame:
    """Net targets of one cycle: budgets, signals and prices as of the instant, sized and netted."""
    return net_targets(size_equal_weight(cycle.capital(universe, asof), cycle.signal(asof), cycle.price(asof), slippage_bps))


def order_deltas(targets: DataFrame, holdings: DataFrame) -> DataFrame:
    """Orders moving current holdings to target * shares; tiny deltas are no order."""
    j = targets.select("symbol", (F.col("target") * F.col("shares")).alias("_want")).join(
        holdings.select("symbol", F.col("qty").alias("_have")), "symbol", "full")
    delta = F.coalesce("_want", F.lit(0.0)) - F.coalesce("_have", F.lit(0.0))
    out = j.withColumn("_delta", delta).where(F.abs("_delta") >= QTY_EPS)
    return out.select("symbol", F.when(F.col("_delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("_delta").alias("qty"))


def first_entry_notional(trades: DataFrame, by: str = "symbol") -> DataFrame:
    """Notional of each group's first closed position in a trade log."""
    return trades.groupBy(by).agg(F.min_by(F.col("shares") * F.col("entry_price"), "ts").alias("notional"))
