"""Cost sensitivity: one pass of fit and signals, then every cost and slippage at once."""

from __future__ import annotations

import weakref
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.functions.scalars import NAN, even_chi2_tail, fisher_half, number
from stridefold.operators.execution import execute, trades
from stridefold.operators.metrics import calculate_metrics
from stridefold.operators.resample import bootstrap_p_values
from stridefold.plans.walk_forward import run_folds


def sweep_configs(costs: Sequence[float] = config.SWEEP_COSTS, slippages: Sequence[float] = config.SWEEP_SLIPPAGES, delay: int = 1) -> list[ExecutionConfig]:
    return [ExecutionConfig(c, s, delay) for c, s in product(costs, slippages)]


def cost_sensitivity_sweep(
    bars: DataFrame,
    strategy,
    plan: FoldPlan | None = None,
    costs: Sequence[float] = config.SWEEP_COSTS,
    slippages: Sequence[float] = config.SWEEP_SLIPPAGES,
    delay: int = 1,
    *,
    seed: int = config.SEED,
    resamples: int = config.RESAMPLES,
) -> DataFrame:
    """(symbol, strategy, cfg_id, cost, slippage, fisher_p); NaN where a run has no trade.

    Signals are kept (memory, then disk) for all that is made of them, until the
    result is no longer referred to.
    """
    configs = sweep_configs(costs, slippages, delay)
    _, _, signals, _, _ = run_folds(bars, strategy, plan or FoldPlan(), configs)
    signals = signals.persist()
    executed = execute(signals, configs)
    windows = bootstrap_p_values(calculate_metrics(executed, trades(executed)), seed, resamples)
    tested = windows.groupBy("symbol", "strategy", "cfg_id").agg(F.sum("trade_count").alias("n"), fisher_half(F.col("p_value")).alias("half"), F.count("*").alias("k"))
    tested = tested.withColumn("fisher_p", F.when(F.col("n") > 0, even_chi2_tail(F.col("half"), F.col("k"))).otherwise(number(NAN)))
    grid = F.array(*(F.struct(F.lit(float(c.transaction_cost_rate)).alias("cost"), F.lit(float(c.slippage_factor)).alias("slippage")) for c in configs))
    result = tested.withColumn("c", F.element_at(grid, F.col("cfg_id") + 1)).select("symbol", "strategy", "cfg_id", "c.cost", "c.slippage", "fisher_p")
    weakref.finalize(result, _release, signals)
    return result


def _release(frame: DataFrame) -> None:
    if frame.sparkSession.sparkContext._jsc is not None:  # the session may have ended before
        frame.unpersist()


def heatmap(sweep: DataFrame, value: str, slippages: Sequence[float] = config.SWEEP_SLIPPAGES) -> DataFrame:
    """Costs down, slippages across."""
    names = [f"slip_{s:g}" for s in slippages]
    wide = sweep.withColumn("slippage", F.concat(F.lit("slip_"), F.format_string("%s", F.regexp_replace(F.format_string("%.3f", "slippage"), "\\.?0+$", ""))))
    return wide.groupBy("symbol", "strategy", "cost").pivot("slippage", names).agg(F.first(value))
