"""Purged, embargoed walk-forward folds in closed form.

Fold k tests positions [s, s + test) and trains on [s - train, s - h - e) with
s = train + k * step. A row's folds follow from its position by arithmetic, so
assigning folds needs neither a join nor a fold table on the driver.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timejoin import master_calendar


@dataclass(frozen=True)
class WalkForward:
    """Window sizes in bars."""

    train: int = 504
    test: int = 63
    step: int = 63
    embargo: int = 3
    horizon: int = 0

    @property
    def gap(self) -> int:
        return self.horizon + self.embargo


def fold_table(calendar: DataFrame, wf: WalkForward) -> DataFrame:
    """One row per fold with its closed train and test ranges; empty trains are left out."""
    n = calendar.agg(F.count(F.lit(1)).alias("n"))
    starts = n.where(F.col("n") >= wf.train + wf.test).select(F.posexplode(F.sequence(
        F.lit(wf.train).cast("bigint"), F.col("n") - wf.test, F.lit(wf.step).cast("bigint"))).alias("fold", "s"))
    folds = starts.select(
        F.col("fold").cast("bigint").alias("fold"), (F.col("s") - wf.train).alias("train_lo"),
        (F.col("s") - 1 - wf.gap).alias("train_hi"), F.col("s").alias("test_lo"),
        (F.col("s") + wf.test - 1).alias("test_hi"))
    return folds.where("train_hi >= train_lo")


def _folds_of(pos: Column, n: Column, wf: WalkForward, role: str) -> Column:
    """Array of the fold numbers in which a position plays ``role``."""
    last = F.floor((n - wf.test - wf.train) / wf.step)
    if role == "test":
        lo = F.ceil((pos - wf.test + 1 - wf.train) / wf.step)
        hi = F.floor((pos - wf.train) / wf.step)
    else:
        lo = F.ceil((pos + 1 + wf.gap - wf.train) / wf.step)
        hi = F.floor(pos / wf.step)
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, last)
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def with_positions(panel: DataFrame) -> DataFrame:
    """Adds the master-calendar position ``pos`` and calendar length ``n_days``."""
    cal = master_calendar(panel).withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy()))
    # One row per date, already gathered by its numbering: the panel need not be shuffled for it.
    return panel.join(F.broadcast(cal), "ts")


def assign_folds(positioned: DataFrame, wf: WalkForward, roles: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """One row per (row, fold, role)."""
    return positioned.withColumn("_c", F.explode(fold_cells(wf, roles))).select(
        *positioned.columns, "_c.fold", "_c.role")


def fold_cells(wf: WalkForward, roles: tuple[str, ...] = ("train", "test")) -> Column:
    """Array of (fold, role) of a row, from its ``pos`` and ``n_days``."""
    if wf.train <= wf.gap:
        return F.array().cast("array<struct<fold:bigint,role:string>>")

    def cells_of(role: str) -> Column:
        return F.transform(_folds_of(F.col("pos"), F.col("n_days"), wf, role), lambda f: F.struct(
            f.cast("bigint").alias("fold"), F.lit(role).alias("role")))

    return F.concat(*[cells_of(role) for role in roles])


def fold_accounting(assigned: DataFrame) -> DataFrame:
    """Training rows and active symbols per fold; symbols are counted by two partial aggregations."""
    per_symbol = assigned.groupBy("fold", "role", "symbol").agg(F.count(F.lit(1)).alias("k"))
    return per_symbol.groupBy("fold").agg(
        F.count(F.when(F.col("role") == "test", 1)).alias("active_symbols"),
        F.sum(F.when(F.col("role") == "train", F.col("k")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(F.col("role") == "test", F.col("k")).otherwise(0)).alias("test_rows"))
