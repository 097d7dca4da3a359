"""Buy and hold per test fold, and how a strategy compares with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import ExecutionConfig
from stridefold.functions.scalars import NAN, number, ratio, student_p
from stridefold.operators.metrics import YEAR, sharpe, sortino, with_drawdown

FOLD = ("symbol", "fold")


def buy_and_hold_returns(test: DataFrame, execution: ExecutionConfig | None = None) -> DataFrame:
    """(symbol, fold, t, r): bar returns of holding through the fold, less entry friction on the first and exit friction on the last.

    Without an execution config there is the standard cost and no slippage. A
    fold of two bars bears both on its one return; shorter ones have none.
    """
    cost, slip = (execution.transaction_cost_rate, execution.slippage_factor) if execution else (config.COST_RATE, 0.0)
    w = Window.partitionBy(*FOLD).orderBy("t")
    spread = F.col("high") - F.col("low") if {"high", "low"} <= set(test.columns) else F.lit(0.0)
    rows = test.select(*FOLD, "t", "close", spread.alias("spread"), F.lead("close").over(w).alias("after"), F.lead(spread).over(w).alias("spread_after"), F.lag(F.lit(1)).over(w).isNull().alias("first"), F.lead(F.lit(1), 2).over(w).isNull().alias("last"))
    entry = F.when(F.col("first"), cost + slip * F.col("spread") / F.greatest(F.col("close"), F.lit(1e-10))).otherwise(0.0)
    leave = F.when(F.col("last"), cost + slip * F.col("spread_after") / F.greatest(F.col("after"), F.lit(1e-10))).otherwise(0.0)
    return rows.where("after is not null").select(*FOLD, "t", (F.try_divide(F.col("after") - F.col("close"), F.col("close")) - entry - leave).alias("r"))


def benchmark_windows(bh: DataFrame) -> DataFrame:
    """Sharpe, Sortino and drawdown of each fold."""
    r = F.col("r")
    return with_drawdown(bh, FOLD).groupBy(*FOLD).agg(sharpe(r).alias("bh_sharpe"), sortino(r).alias("bh_sortino"), F.min("dd").alias("bh_max_drawdown"))


def active_returns(returns: DataFrame, bh: DataFrame) -> DataFrame:
    """Strategy less benchmark, bar by bar; an equity return belongs to the bar it ends at, a benchmark return to the one it starts from."""
    own = returns.withColumn("t", F.col("t") - 1)
    return own.join(bh.withColumnRenamed("r", "bh"), ["symbol", "fold", "t"]).withColumn("active", F.col("r") - F.col("bh"))


def information_ratio(active: DataFrame) -> DataFrame:
    a = F.col("active")
    return active.groupBy("symbol", "strategy").agg(F.when(F.count(a) < 1, number(NAN)).otherwise(ratio(F.avg(a), F.stddev_samp(a), config.FLAT_STD, 0.0) * YEAR).alias("information_ratio"))


def sharpe_comparison(windows: DataFrame, bh_windows: DataFrame) -> DataFrame:
    """Means of the benchmark, t-test of Sharpe differences, share of folds that beat it, and its Sharpe by fold."""
    both = windows.join(bh_windows, list(FOLD)).withColumn("diff", F.col("sharpe_ratio") - F.col("bh_sharpe"))
    sums = both.groupBy("symbol", "strategy").agg(
        F.avg("bh_sharpe").alias("benchmark_sharpe"),
        F.avg("bh_sortino").alias("benchmark_sortino"),
        F.min("bh_max_drawdown").alias("benchmark_max_drawdown"),
        F.avg("diff").alias("mean"),
        F.stddev_samp("diff").alias("sd"),
        F.count("*").alias("k"),
        F.avg((F.col("sharpe_ratio") > F.col("bh_sharpe")).cast("double")).alias("strategy_beats_benchmark_fraction"),
        F.transform(F.sort_array(F.collect_list(F.struct("fold", "bh_sharpe"))), lambda x: x.bh_sharpe).alias("per_window_benchmark_sharpes"),
    )
    t = F.when(F.col("k") < 2, number(NAN)).otherwise(F.coalesce(F.try_divide(F.col("mean"), F.col("sd") / F.sqrt(F.col("k").cast("double"))), number(NAN)))
    return sums.withColumn("sharpe_diff_t_stat", t).withColumn("sharpe_diff_p_value", F.when(F.isnan("sharpe_diff_t_stat"), number(NAN)).otherwise(student_p(F.col("sharpe_diff_t_stat"), F.col("k") - 1))).drop("mean", "sd", "k")


def compute_benchmark(windows: DataFrame, returns: DataFrame, test: DataFrame, execution: ExecutionConfig | None = None) -> DataFrame:
    """One row per (symbol, strategy)."""
    bh = buy_and_hold_returns(test, execution)
    return sharpe_comparison(windows, benchmark_windows(bh)).join(information_ratio(active_returns(returns, bh)), ["symbol", "strategy"], "left")
