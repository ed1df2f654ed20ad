"""Signal replay: bars and signals to equity and trades, per group.

A group is one (run, fold, symbol): at most the bars of a test window, or of one
symbol's calendar when a path runs through. Whole-share truncation makes the path
depend on all earlier fills, so no window expression can give the exact result.
Spark shuffles and sorts the bars; a task walks the groups of a chunk side by side,
one bar of each at a time.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.windows import whole_groups


@dataclass(frozen=True)
class Costs:
    """Default commission per share, slippage and liquidity cap."""

    commission_per_share: float = 0.005
    slippage_bps: float = 5.0
    liquidity_cap: float = 0.10


BACKTEST_COSTS = Costs()
PAPER_COSTS = Costs(commission_per_share=0.0)
INITIAL_CAPITAL = 100_000.0
COST_ORDER = ("commission_per_share", "slippage_bps", "liquidity_cap")

_POINT = "struct<ts:timestamp,equity:double,ret:double>"
_TRADE = ("struct<ts:timestamp,entry_price:double,exit_price:double,shares:bigint,"
          "gross_pnl:double,commission:double,net_pnl:double>")

#: Bars that one step of a task works on, at least one whole group.
CHUNK = 250_000
#: Stands for a missing signal: the position is kept.
_HOLD = 9


def _walk(starts: np.ndarray, sizes: np.ndarray, open_: np.ndarray, volume: np.ndarray, target: np.ndarray, slip: np.ndarray,
          fee: np.ndarray, cap: np.ndarray, capital: float) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Bar by bar over all groups side by side: fill the pending signal, mark equity, close at the end.

    Returns the equity after every bar and the two trades a bar can close, at its open and at the
    group's end, as (position, entry, exit) per bar, position 0 where there is none. NaN is missing.
    """
    equity_ = np.empty(len(open_))
    closed, forced = ([np.zeros(len(open_)) for _ in range(3)] for _ in range(2))
    longest = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[longest], sizes[longest]
    cash, pos, entry = np.full(len(starts), capital), np.zeros(len(starts)), np.zeros(len(starts))
    left = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # groups that have a bar number j
    for j, k in enumerate(left):
        i = starts[:k] + j
        cash, pos, entry, o, s, f = cash[:k], pos[:k], entry[:k], open_[i], slip[i], fee[i]
        side = np.sign(pos)
        want = np.where(target[i] == _HOLD, side, target[i])
        moves = want != side
        shut = moves & (pos != 0)
        out = o * (1 - s * side)
        cash = np.where(shut, cash + (pos * out - np.abs(pos) * f), cash)
        for log, v in zip(closed, (pos, entry, out)):
            log[i[shut]] = v[shut]
        fill = o * (1 + s * want)
        affordable = np.where(fill > 0, np.trunc(cash / fill), 0.0)
        shares = np.where(moves & (want != 0), np.fmax(0.0, np.fmin(affordable, np.trunc(volume[i] * cap[i]))), 0.0)
        cash = cash - (want * shares * fill + shares * f)
        pos = np.where(moves, shares * want, pos)
        entry = np.where(shares > 0, fill, np.where(moves, 0.0, entry))
        ends = (sizes[:k] == j + 1) & (pos != 0)
        out = o * (1 - s * np.sign(pos))
        equity_[i] = np.where(ends, cash + (pos * out - np.abs(pos) * f), cash + pos * o)
        for log, v in zip(forced, (pos, entry, out)):
            log[i[ends]] = v[ends]
    return equity_, [tuple(closed), tuple(forced)]


def _spread(rows: pa.Table, group: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Bars of whole groups laid out once per layer: the layers' fields, each entry's bar, and the groups' first entries."""
    cells = rows["_layers"].combine_chunks()
    of, flat = pc.list_parent_indices(cells).to_numpy(), pc.list_flatten(cells)
    fields = pa.table(flat.flatten(), [f.name for f in flat.type])
    key = group[of]
    for name in fields.column_names:
        found = fields[name].combine_chunks().dictionary_encode()
        key = key * (len(found.dictionary) + 1) + found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)
    line = np.argsort(key, kind="stable")
    key = key[line]
    return fields.take(pa.array(line)), of[line], np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _path(starts: np.ndarray, signal: np.ndarray, open_: np.ndarray, volume: np.ndarray, slip: np.ndarray, fee: np.ndarray, cap: np.ndarray,
          capital: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Equity, its return on the bar before (NaN at a group's first bar) and the trades, of groups that follow each other."""
    target = np.concatenate([[_HOLD], signal[:-1]])
    target[starts] = _HOLD
    with np.errstate(all="ignore"):
        equity_, kinds = _walk(starts, np.diff(np.append(starts, len(signal))), open_, volume, target, slip, fee, cap, capital)
        before = np.concatenate([[np.nan], equity_[:-1]])
        before[starts] = np.nan
        return equity_, equity_ / np.where(before == 0, np.nan, before) - 1, kinds


def _replayed(rows: pa.Table, by: Sequence[str], fixed: Mapping[str, float], capital: float) -> pa.RecordBatch:
    """One row per group, from bars of whole groups that follow each other by time."""
    plain = lambda c: c.combine_chunks().to_numpy(zero_copy_only=False)
    last = plain(rows["last"])
    starts, bar, layers = np.flatnonzero(np.concatenate([[True], last[:-1]])), None, {}
    if "_layers" in rows.column_names:
        fields, bar, starts = _spread(rows, np.cumsum(last) - last)
        layers = {c: fields[c] for c in fields.column_names}
        rows = rows.drop_columns(["_layers"])
    lay = lambda c: layers[c] if c in layers else rows[c] if bar is None else rows[c].take(pa.array(bar))
    n = rows.num_rows if bar is None else len(bar)
    number = lambda c: np.full(n, fixed[c]) if c in fixed else plain(lay(c)).astype(float)
    fee, slip, cap = (number(c) for c in COST_ORDER)
    bounds = np.concatenate([starts, [n]])
    equity_, ret, kinds = _path(starts, number("signal"), number("open"), number("volume"), slip / 10_000, fee, cap, capital)
    with np.errstate(all="ignore"):
        at = np.concatenate([np.flatnonzero(k[0]) for k in kinds])
        pos, entry, out = (np.concatenate([k[c][k[0] != 0] for k in kinds]) for c in range(3))
        line = np.argsort(at, kind="stable")
        at, pos, entry, out = at[line], pos[line], entry[line], out[line]
        shares = np.abs(pos)
        gross, paid = shares * (out - entry) * np.sign(pos), shares * fee[at] * 2
    ts = lay("ts").combine_chunks()
    nulls = lambda x: pa.array(x, from_pandas=True)
    points = pa.StructArray.from_arrays([ts, nulls(equity_), nulls(ret)], ["ts", "equity", "ret"])
    log = pa.StructArray.from_arrays(
        [ts.take(pa.array(at)), nulls(entry), nulls(out), pa.array(shares.astype("int64")), nulls(gross), nulls(paid), nulls(gross - paid)],
        ["ts", "entry_price", "exit_price", "shares", "gross_pnl", "commission", "net_pnl"])
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for ends, x in ((bounds, points), (np.searchsorted(at, bounds), log))]
    keys = [lay(c).combine_chunks().take(pa.array(starts)) for c in by]
    return pa.RecordBatch.from_arrays([*keys, *lists], [*by, "eq", "trades"])


def _lined(bars: DataFrame, own: Sequence[str], signals: Mapping[str, str], costs: Sequence[str], more: Mapping[str, Column]) -> DataFrame:
    """What a replay reads of the bars, whole groups in one task and by time; ``last`` marks a group's last bar."""
    w = Window.partitionBy(*own).orderBy("ts")
    rows = bars.select(
        *own, "ts", F.col("open").cast("double"), F.col("volume").cast("double"),
        *[F.coalesce(F.col(c).cast("int"), F.lit(_HOLD)).alias(name) for name, c in signals.items()], *costs,
        F.lead("ts").over(w).isNull().alias("last"), *[c.alias(name) for name, c in more.items()])
    # The window has put a group's bars into one task, in this order already.
    return rows.sortWithinPartitions(*own, "ts")


def replay(bars: DataFrame, by: Sequence[str], costs: Costs | None = None, capital: float = INITIAL_CAPITAL,
           signal: str = "signal", layers: str | None = None) -> DataFrame:
    """One row per group with arrays ``eq`` and ``trades``.

    ``bars`` has ts, open, volume and a signal in {-1, 0, 1}; a signal at one bar
    fills at the next bar's open. Without ``costs`` the columns
    commission_per_share, slippage_bps and liquidity_cap are read from the rows, so
    that a cost set can be a group key. ``eq`` holds each bar's equity and its
    return on the bar before, none at a group's first bar.

    ``layers`` names an array of structs: the runs a bar takes part in (folds, cost sets). Their fields
    stand beside the bar's columns, as keys in ``by`` or as costs; a bar is moved and sorted
    once for all its layers.
    """
    inner = bars.schema[layers].dataType.elementType if layers else T.StructType()
    own = [c for c in by if c not in inner.names]
    fixed = {c: v for c, v in vars(costs).items() if c not in inner.names} if costs is not None else {}
    rows = _lined(bars, own, {"signal": signal}, [c for c in COST_ORDER if c not in inner.names and c not in fixed],
                  {"_layers": F.col(layers)} if layers else {})

    def weigh(b: pa.RecordBatch) -> int:
        return len(pc.list_flatten(b.column("_layers"))) if layers else b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CHUNK, weigh):
            yield _replayed(table, by, fixed, capital)

    keys = [T.StructField(c, (inner if c in inner.names else rows.schema)[c].dataType) for c in by]
    logs = [T.StructField(c, T.ArrayType(T.DataType.fromDDL(kind))) for c, kind in (("eq", _POINT), ("trades", _TRADE))]
    return rows.mapInArrow(run, T.StructType([*keys, *logs]))


def equity(replayed: DataFrame, by: Sequence[str]) -> DataFrame:
    return replayed.select(*by, F.explode("eq").alias("_e")).select(*by, "_e.ts", "_e.equity")


def trades(replayed: DataFrame, by: Sequence[str]) -> DataFrame:
    return replayed.select(*by, F.explode("trades").alias("_t")).select(*by, "_t.*")


def bar_returns(eq: DataFrame, by: Sequence[str]) -> DataFrame:
    """Returns inside a group; a group's first bar has none, so folds never touch."""
    w = Window.partitionBy(*by).orderBy("ts")
    out = eq.withColumn("ret", F.try_divide("equity", F.lag("equity").over(w)) - 1)
    return out.where("ret IS NOT NULL")


def replay_returns(bars: DataFrame, by: Sequence[str], costs: Costs | None = None, **kw) -> DataFrame:
    points = replay(bars, by, costs, **kw).select(*by, F.explode("eq").alias("_e"))
    return points.select(*by, "_e.ts", "_e.equity", "_e.ret").where("ret IS NOT NULL")


def cross_section_mean(rows: DataFrame, by: Sequence[str], value: str = "ret") -> DataFrame:
    """Equal-weight mean over whatever is present at each bar."""
    return rows.groupBy(*by, "ts").agg(F.avg(value).alias(value), F.count(value).alias("n_symbols"))


def _totals(rows: pa.Table, by: Sequence[str], signals: Sequence[str], fixed: Mapping[str, float], capital: float) -> pa.RecordBatch:
    """Per signal and (by, ts): sum and count of the returns of whole groups."""
    plain = lambda c: rows[c].combine_chunks().to_numpy(zero_copy_only=False)
    number = lambda c: np.full(rows.num_rows, fixed[c]) if c in fixed else plain(c).astype(float)
    starts = np.flatnonzero(np.concatenate([[True], plain("last")[:-1]]))
    key = np.zeros(rows.num_rows, np.int64)
    for c in (*by, "ts"):
        found = rows[c].combine_chunks().dictionary_encode()
        key = key * (len(found.dictionary) + 1) + found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)
    _, at, cell = np.unique(key, return_index=True, return_inverse=True)
    open_, volume, (fee, slip, cap) = number("open"), number("volume"), (number(c) for c in COST_ORDER)
    parts = []
    for i, name in enumerate(signals):
        ret = _path(starts, number(f"_s{i}"), open_, volume, slip / 10_000, fee, cap, capital)[1]
        there = ~np.isnan(ret)
        k = np.bincount(cell[there], minlength=len(at))
        total = np.bincount(cell[there], ret[there], len(at))
        some = k > 0
        keys = rows.select([*by, "ts"]).take(pa.array(at[some]))
        parts.append(pa.table({"signal": pa.array([name] * len(keys), pa.string()), **{c: keys[c] for c in keys.column_names},
                               "_total": total[some], "_k": k[some].astype(np.int64)}))
    return pa.concat_tables(parts).combine_chunks()


def mean_returns(bars: DataFrame, by: Sequence[str], signals: Mapping[str, str], costs: Costs | None = None, over: str = "symbol",
                 capital: float = INITIAL_CAPITAL) -> DataFrame:
    """(signal, by, ts, ret, n_symbols): ``cross_section_mean`` of ``replay_returns`` of several signals.

    ``signals`` names columns that stand side by side in a bar's row, so a bar is moved and sorted once for
    all of them. Groups are (by, over); tasks add up the returns of a chunk of whole groups per bar
    and Spark adds up the chunks, so paths never become rows.
    """
    own = [*by, over]
    fixed = vars(costs) if costs is not None else {}
    rows = _lined(bars, own, {f"_s{i}": c for i, c in enumerate(signals.values())}, [c for c in COST_ORDER if c not in fixed], {})
    names = list(signals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, max(1, CHUNK // len(names))):
            yield from _totals(table, by, names, fixed, capital).to_batches()

    kept = [rows.schema[c] for c in (*by, "ts")]
    parts = rows.mapInArrow(run, T.StructType([T.StructField("signal", T.StringType()), *kept, T.StructField("_total", T.DoubleType()),
                                               T.StructField("_k", T.LongType())]))
    return parts.groupBy("signal", *by, "ts").agg((F.sum("_total") / F.sum("_k")).alias("ret"), F.sum("_k").alias("n_symbols"))


def portfolio_equity(returns: DataFrame, by: Sequence[str], capital: float = INITIAL_CAPITAL) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", capital * F.product(1 + F.col("ret")).over(w))


def sign_signal(pred: Column | str, threshold: float = 0.0) -> Column:
    p = F.col(pred) if isinstance(pred, str) else pred
    return F.coalesce(F.signum(F.nanvl(p, F.lit(threshold)) - threshold), F.lit(0.0)).cast("int")


def growth_multiple(eq: DataFrame, by: Sequence[str]) -> DataFrame:
    return eq.groupBy(*by).agg(
        F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")).alias("multiple"))


def vector_replay(bars: DataFrame, by: Sequence[str], slippage_bps: float = 5.0, signal: str = "signal") -> DataFrame:
    """Window-only approximation for large sweeps. NOT share-exact: no whole shares,
    no cash limit, no cap."""
    w = Window.partitionBy(*by).orderBy("ts")
    pos = F.coalesce(F.lag(F.col(signal)).over(w), F.lit(0))
    out = bars.withColumn("_pos", pos)
    move = F.try_divide(F.lead("open").over(w), F.col("open")) - 1
    turn = F.abs(F.col("_pos") - F.coalesce(F.lag("_pos").over(w), F.lit(0)))
    return out.select(*by, "ts", (F.col("_pos") * move - turn * slippage_bps / 10_000).alias("ret")).where("ret IS NOT NULL")


def always_long_growth(benchmark: DataFrame, days: DataFrame, costs: Costs = BACKTEST_COSTS) -> DataFrame:
    """Benchmark held from the first date, net of costs, normalised to 1.

    ``benchmark`` has one row per date (ts, close), ``days`` the dates to align to; the
    price is carried forward. Empty when the benchmark starts after the first date.
    """
    line = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # calendar-sized
    marks = days.select("ts").distinct().withColumn("_want", F.lit(True)).join(benchmark.select("ts", "close"), "ts", "full")
    carried = marks.withColumn("open", F.last("close", ignorenulls=True).over(line)).where("_want")
    covered = carried.withColumn("_gaps", F.count_if(F.col("open").isNull()).over(Window.partitionBy())).where("_gaps = 0")
    rows = covered.select(F.lit("benchmark").alias("run"), "ts", "open", F.lit(1e15).alias("volume"), F.lit(1).alias("signal"))
    eq = equity(replay(rows, ["run"], costs), ["run"])
    first = F.min_by("equity", "ts").over(Window.partitionBy("run"))
    return eq.select("ts", F.try_divide("equity", first).alias("growth"))


def cost_steps(a: Costs, b: Costs) -> list[tuple[int, str, Costs]]:
    """Cost sets from ``a`` to ``b``, one differing parameter switched at a time."""
    steps, current = [(0, "start", a)], dict(vars(a))
    for name in COST_ORDER:
        if getattr(a, name) != getattr(b, name):
            current = {**current, name: getattr(b, name)}
            steps.append((len(steps), name, Costs(**current)))
    return steps


def _cost_sets(steps: Sequence[tuple[int, str, Costs]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("changed"),
                              *[F.lit(float(v)).alias(k) for k, v in vars(c).items()]) for i, n, c in steps])


def cost_decomposition(bars: DataFrame, a: Costs = BACKTEST_COSTS, b: Costs = PAPER_COSTS, key: str = "symbol") -> DataFrame:
    """Growth multiple after each cost switch and the relative change it caused."""
    by = [key, "step", "changed"]
    rep_ = replay(bars.withColumn("_sets", _cost_sets(cost_steps(a, b))), by, layers="_sets")
    mult = rep_.select(*by, F.size("trades").alias("n_trades"), F.try_divide(
        F.element_at("eq", -1)["equity"], F.element_at("eq", 1)["equity"]).alias("multiple"))
    w = Window.partitionBy(key).orderBy("step")
    return mult.withColumn("component", F.try_divide("multiple", F.lag("multiple").over(w)) - 1)


def reconciliation(decomposed: DataFrame, key: str = "symbol", max_delta: float = 0.01, eps: float = 1e-9) -> DataFrame:
    """Verdict per symbol: trades placed, gap within the limit and fully explained."""
    out = decomposed.groupBy(key).agg(
        F.min_by("multiple", "step").alias("backtest_multiple"), F.max_by("multiple", "step").alias("paper_multiple"),
        F.min_by("n_trades", "step").cast("bigint").alias("n_trades"), F.product(1 + F.coalesce("component", F.lit(0.0))).alias("_chain"))
    out = out.withColumns({
        "relative_delta": F.try_divide("paper_multiple", "backtest_multiple") - 1,
        "unexplained": F.col("paper_multiple") - F.col("backtest_multiple") * F.col("_chain")}).drop("_chain")
    ok = (F.col("n_trades") > 0) & (F.abs("relative_delta") <= max_delta) & (F.abs("unexplained") <= eps)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))
