"""The registered feature columns, all point-in-time."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as win
from tidemark.operators.ranks import percent_rank_columns
from tidemark.operators.timejoin import attach_macro, document_windows, with_daily_documents

# Series, their publication lags in business days, and thresholds.
MACRO_SERIES = ("DGS10", "DFF", "VIXCLS")
PUBLICATION_LAGS = {"DGS10": 1, "DFF": 1, "VIXCLS": 1}
VIX_LOW, VIX_HIGH = 15.0, 25.0
RANKED = ("ret_21d", "ret_252d", "vol_21d")
PRICE_COLUMNS = ("ret_1d", "ret_5d", "ret_21d", "vol_21d", "vol_63d", "mom_21d", "rsi_14", "log_volume",
                 "ret_252d", "ret_126d", "ma200_ratio", "ma50_ratio", "volume_ratio")
REGIME_COLUMNS = ("vix_regime", "curve_inverted", "vol_regime_ratio", "trend_regime")
DOCUMENT_COLUMNS = ("sentiment_score", "doc_count", "has_coverage")
#: The full registered set: price, macro, regime, document and cross-section columns.
ALL_COLUMNS = (*PRICE_COLUMNS, *MACRO_SERIES, "yield_curve", *REGIME_COLUMNS, *DOCUMENT_COLUMNS, *[f"xs_rank_{c}" for c in RANKED])


#: What a price column needs: bars back to a close, or frames as (kind, values, length).
_LAGS = {"ret_1d": 1, "ret_5d": 5, "ret_21d": 21, "ret_126d": 126, "ret_252d": 252}
_FRAMES = {"vol_21d": [("std", "ret_1d", 21)], "vol_63d": [("std", "ret_1d", 63)], "mom_21d": [("sum", "ret", 21)],
           "rsi_14": [("sum", "up", 14), ("sum", "down", 14)], "ma200_ratio": [("sum", "close", 200)],
           "ma50_ratio": [("sum", "close", 50)], "volume_ratio": [("sum", "volume", 63)]}


def price_features(bars: DataFrame, columns: Sequence[str] = PRICE_COLUMNS) -> DataFrame:
    """Thirteen price and volume columns, or some of them, from one shuffle on symbol.

    Catalyst cannot drop an unused moving frame, so name the columns where few are read.
    """
    unknown = set(columns) - set(PRICE_COLUMNS)
    if unknown:
        raise ValueError(f"no such price columns: {sorted(unknown)}")
    diff = F.col("close") - F.lag("close", 1).over(win.per("symbol"))
    sources = {"close": "close", "volume": "volume", "ret": "ret_1d", "up": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))),
               "down": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0)))}
    frames = [f for c in columns for f in _FRAMES.get(c, ())]
    lengths = lambda kind: {c: tuple(n for k, x, n in frames if (k, x) == (kind, c)) for k, c, _ in frames if k == kind}
    sums, spreads = lengths("sum"), lengths("std")
    lags = [c for c in _LAGS if c in columns or c == "ret_1d" and ("ret" in sums or spreads)]
    base = bars.withColumns({c: win.pct_change("close", _LAGS[c]) for c in lags})
    if frames:
        base = win.in_blocks(base, {c: (sources[c], n) for c, n in sums.items()}, spreads)
    mean = lambda c, n: F.col(f"_sum_{c}_{n}") / n
    made = {
        "vol_21d": lambda: F.col("_std_ret_1d_21"), "vol_63d": lambda: F.col("_std_ret_1d_63"), "mom_21d": lambda: F.signum("_sum_ret_21"),
        "rsi_14": lambda: 100 - F.lit(100.0) / (1 + F.try_divide(mean("up", 14), mean("down", 14))),
        "log_volume": lambda: F.log1p("volume"),
        "ma200_ratio": lambda: F.try_divide("close", mean("close", 200)), "ma50_ratio": lambda: F.try_divide("close", mean("close", 50)),
        "volume_ratio": lambda: F.try_divide("volume", mean("volume", 63))}
    return base.select(*bars.columns, *[made[c]().alias(c) if c in made else F.col(c) for c in columns])


def regime_flags(feat: DataFrame) -> DataFrame:
    """Same columns whether or not macro data was attached."""
    missing = [c for c in (*MACRO_SERIES, "yield_curve") if c not in feat.columns]
    feat = feat.withColumns({c: F.lit(None).cast("double") for c in missing})
    vix = F.col("VIXCLS")
    return feat.withColumns({
        "vix_regime": F.when(vix <= VIX_LOW, 0.0).when(vix >= VIX_HIGH, 2.0).when(vix.isNotNull(), 1.0),
        "curve_inverted": (F.col("yield_curve") < 0).cast("double"),
        "vol_regime_ratio": F.try_divide("vol_21d", "vol_63d"),
        "trend_regime": (F.col("ma200_ratio") > 1).cast("double")})


def with_macro(feat: DataFrame, macro: DataFrame, start: str, end: str,
               lags: Mapping[str, int] | None = PUBLICATION_LAGS) -> DataFrame:
    out = attach_macro(feat, macro, MACRO_SERIES, start, end, lags)
    return out.withColumn("yield_curve", F.col("DGS10") - F.col("DFF"))


def build_features(bars: DataFrame, macro: DataFrame | None = None, docs: DataFrame | None = None, *,
                   start: str, end: str, lags: Mapping[str, int] | None = PUBLICATION_LAGS,
                   lookback_days: int = 30, asof: str | None = None, ranks: bool = False, daily: bool = False) -> DataFrame:
    """The full feature table; warm-up rows stay, with NULLs.

    ``daily`` states that bars are whole days stamped at midnight: documents then stand in a symbol's line beside its
    bars, which are shuffled once for prices and documents. Bars are used again for ranks, and for document windows that are
    not daily: pass a written table if they are costly, and only the columns that are wanted, since all of them are moved.
    What follows from the day or from other columns of the row is added after the ranks, so it is not moved.

    ``asof`` cuts bars, observations and documents before any window: Catalyst cannot move
    a time filter below one, and look-ahead is ruled out by construction.
    """
    if asof is not None:
        until = F.lit(asof).cast("timestamp")
        bars = bars.where(F.col("ts") <= until)
        macro = macro if macro is None else macro.where(F.col("timestamp") <= until)
        docs = docs if docs is None else docs.where(F.col("published_at") <= until)
    feat = price_features(with_daily_documents(bars, docs, lookback_days) if docs is not None and daily else bars)
    if docs is not None and not daily:
        feat = feat.join(document_windows(docs, bars.select("symbol", "ts"), lookback_days), ["symbol", "ts"], "left")
    if ranks:
        feat = percent_rank_columns(feat, RANKED, rows=bars)
    return regime_flags(feat if macro is None else with_macro(feat, macro, start, end, lags))


def crossover_signal(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """1 above, -1 below, 0 while either mean is warming up."""
    f, s = win.rolling_mean("close", fast), win.rolling_mean("close", slow)
    return bars.withColumn("signal", F.when(f > s, 1).when(f < s, -1).otherwise(0))
