"""Signals (-1, 0, 1) and what they imply: positions, delays, returns. Rows are ordered by ``t`` within KEYS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol", "strategy", "fold")


def over(keys: Sequence[str] = KEYS) -> Window:
    return Window.partitionBy(*keys).orderBy("t")


def held(sig: Column, keys: Sequence[str] = KEYS) -> Column:
    """Position after holding the last non-zero signal: true while it was a buy."""
    return F.coalesce(F.last(F.nullif(sig, F.lit(0)), ignorenulls=True).over(over(keys).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1


def delayed(sig: Column, bars: int, keys: Sequence[str] = KEYS) -> Column:
    """The signal ``bars`` bars later; the last ones are lost."""
    return sig if bars == 0 else F.coalesce(F.lag(sig, bars).over(over(keys)), F.lit(0))


def crossings(up: Column, keys: Sequence[str] = KEYS) -> Column:
    """1 where the indicator turns true, -1 where it turns false, 0 at the first row."""
    now = up.cast("int")
    return now - F.coalesce(F.lag(now).over(over(keys)), now)


def bar_return(keys: Sequence[str] = KEYS) -> Column:
    """Simple return to the next bar; 0 where it is not finite, null at the last bar."""
    close = F.col("close").cast("double")
    r = F.try_divide(F.lead(close).over(over(keys)) - close, close)
    last = F.lead(F.lit(1)).over(over(keys)).isNull()
    return F.when(~last, F.coalesce(F.when(F.abs(r) < float("inf"), r), F.lit(0.0)))


def returns_from_signals(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, t, r): each bar's return while the position is held; one row fewer than bars per group."""
    out = rows.select(*keys, "t", held(F.col("sig"), keys).alias("position"), bar_return(keys).alias("next"))
    return out.where("next is not null").select(*keys, "t", F.when(F.col("position"), F.col("next")).otherwise(0.0).alias("r"))


def bad_signals(rows: DataFrame) -> DataFrame:
    """The rows whose signal is none of -1, 0 and 1."""
    return rows.where(F.col("sig").isNull() | ~F.col("sig").isin(-1, 0, 1))


def check_signals(rows: DataFrame) -> DataFrame:
    """The rows, if every signal is -1, 0 or 1."""
    bad = bad_signals(rows).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"signals must be -1, 0 or 1, got {bad.first().sig}")
    return rows


def aligned(bars: DataFrame, signals: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars with their signals, row for row; differing counts raise."""
    on = [*keys, "ts"]
    odd = bars.select(*on, F.lit(1).alias("b")).join(signals.select(*on, F.lit(1).alias("s")), on, "full_outer").where("b is null or s is null").limit(1)
    if not odd.isEmpty():
        raise ValueError("signals and bars must have the same timestamps")
    return bars.join(signals.select(*on, "sig"), on)
