"""Performance metrics of equity curves: one window and one grouped aggregate, no shuffle between them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefold import config
from stridefold.functions.scalars import INF, NAN, number, ratio
from stridefold.operators.execution import RUN

YEAR = math.sqrt(config.BARS_PER_YEAR)


def equity_returns(executed: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, t, ts, r): equity returns; the first bar has none."""
    return _returned(executed, keys).select(*keys, "t", "ts", "r").where("r is not null")


def _returned(executed: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t")
    return executed.withColumn("r", F.nanvl(F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1, F.lit(None).cast("double")))


def with_drawdown(returns: DataFrame, keys: Sequence[str] = RUN, order: Sequence[str] = ("t",)) -> DataFrame:
    """Adds ``dd``: the fall of the compounded curve, which starts at 1, below its peak."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("grown", F.product(1 + F.col("r")).over(w))
    return grown.withColumn("peak", F.greatest(number(1.0), F.max("grown").over(w))).withColumn("dd", F.try_divide(F.col("grown") - F.col("peak"), F.col("peak"))).drop("grown", "peak")


def sharpe(r: Column) -> Column:
    excess = r - config.RISK_FREE
    return ratio(F.avg(excess), F.stddev_samp(excess), config.FLAT_STD, 0.0) * YEAR


def sortino(r: Column) -> Column:
    excess = r - config.RISK_FREE
    return ratio(F.avg(excess), F.sqrt(F.avg(F.when(excess.isNotNull(), F.pow(F.least(excess, number(0.0)), 2)))), config.FLAT_STD, INF) * YEAR


def calmar(r: Column, worst: Column) -> Column:
    """Geometric annual return over the worst fall; ``worst`` is an aggregate over unclipped returns."""
    annual = F.pow(F.product(F.when(r.isNotNull(), 1 + F.greatest(r, number(-0.9999)))), config.BARS_PER_YEAR / F.count(r)) - 1
    return ratio(annual, F.abs(worst), 1e-10, INF)


def omega(r: Column, threshold: float = config.RISK_FREE) -> Column:
    gains, losses = F.sum(F.greatest(r - threshold, number(0.0))), F.sum(F.greatest(threshold - r, number(0.0)))
    return ratio(gains, losses, 1e-10, INF)


def return_metrics(returns: DataFrame, keys: Sequence[str] = RUN, *more: Column) -> DataFrame:
    """Sharpe, Sortino, drawdown, Calmar and omega per group, and the returns in order for resampling. Null returns are passed over."""
    r = F.col("r")
    return with_drawdown(returns, keys).groupBy(*keys).agg(
        sharpe(r).alias("sharpe_ratio"),
        sortino(r).alias("sortino_ratio"),
        F.min("dd").alias("max_drawdown"),
        calmar(r, F.min("dd")).alias("calmar_ratio"),
        omega(r).alias("omega_ratio"),
        F.transform(F.sort_array(F.collect_list(F.when(r.isNotNull(), F.struct("t", "r")))), lambda x: x.r).alias("returns"),  # a fold's bars
        *more,
    )


def trade_metrics(trades: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))
    return trades.groupBy(*keys).agg(
        F.count("*").cast("int").alias("trade_count"),
        F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.when(win.isNull(), number(0.0)).when(loss.isNull(), number(INF)).otherwise(F.try_divide(win, F.abs(loss))).alias("avg_win_loss_ratio"),
        F.avg(F.datediff("exit_ts", "entry_ts").cast("double")).alias("avg_holding_days"),
    )


def exposure(executed: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Share of bars from entry to exit, both included."""
    return executed.groupBy(*keys).agg(_inside(), F.count("*").alias("n_bars"))


def _inside() -> Column:
    return F.avg((F.col("position") | F.col("exit")).cast("double")).alias("exposure_fraction")


#: What a fold without trades counts as.
FLAT = {"sharpe_ratio": 0.0, "sortino_ratio": 0.0, "max_drawdown": 0.0, "calmar_ratio": NAN, "omega_ratio": NAN, "exposure_fraction": 0.0, "win_rate": NAN, "avg_win_loss_ratio": NAN, "avg_holding_days": NAN}


def calculate_metrics(executed: DataFrame, trades: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One row per group: all metrics but the resampled p-value. Groups without trades get the flat values.

    Only finished results stay: NaN is undefined, infinity unbounded, both as doubles.
    """
    whole = return_metrics(_returned(executed, keys), keys, _inside()).join(trade_metrics(trades, keys), list(keys), "left")
    idle = F.col("trade_count").isNull()
    return whole.select(*keys, *(F.when(idle, number(v)).otherwise(F.coalesce(F.col(n), number(NAN))).alias(n) for n, v in FLAT.items()), F.coalesce("trade_count", F.lit(0)).alias("trade_count"), idle.alias("flat_cash"), "returns")
