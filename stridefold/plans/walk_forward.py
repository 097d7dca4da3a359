"""The walk-forward plan: every symbol, fold, candidate and config in one DAG."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.functions.scalars import NAN, number
from stridefold.operators.benchmark import buy_and_hold_returns, compute_benchmark
from stridefold.operators.execution import execute, trades
from stridefold.operators.folds import fold_table, test_rows
from stridefold.operators.metrics import calculate_metrics, equity_returns
from stridefold.operators.resample import bootstrap_p_values, candidate_matrix, reality_checks
from stridefold.operators.summary import summarise
from stridefold.plans.models import Backtest
from stridefold.plans.strategies import BaseStrategy, Custom, GridStrategy


def planned(strategy):
    return Custom(strategy) if isinstance(strategy, BaseStrategy) else strategy


def run_folds(bars: DataFrame, strategy, plan: FoldPlan, configs: Sequence[ExecutionConfig]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(featured, fitted, signals, executed, trades). Costs touch neither fit nor signals, so configs multiply only what follows them."""
    strategy = planned(strategy)
    featured = strategy.featured(bars, plan)
    fitted = strategy.fit(featured, plan)
    signals = strategy.signals(featured, fitted, plan)
    executed = execute(signals, configs)
    return featured, fitted, signals, executed, trades(executed)


def walk_forward(
    bars: DataFrame,
    strategy,
    plan: FoldPlan | None = None,
    execution: ExecutionConfig | None = None,
    *,
    seed: int = config.SEED,
    resamples: int = config.RESAMPLES,
    rc_parts: int = 4,
    check: bool = True,
) -> Backtest:
    """Backtest of a strategy on all symbols of ``bars`` (symbol, ts, i, close[, high, low]).

    Fitted folds and executed bars are kept (memory, then disk) for the branches
    that share them. With ``check``, no fold or no trade at all is a ValueError,
    and folds whose fit did not converge are named in a warning. ``rc_parts``
    tasks share the resamples of a Reality Check.
    """
    plan, strategy = plan or FoldPlan(), planned(strategy)
    if check and bars.groupBy("symbol").count().where(F.col("count") >= plan.min_rows).isEmpty():
        raise ValueError(f"no fold fits: {plan.min_rows} bars are needed")
    execution = execution or ExecutionConfig()
    featured, fitted, signals, executed, done = run_folds(bars, strategy, plan, [execution])
    fitted, executed = fitted.persist(), executed.persist()
    done = trades(executed)
    if check and "converged" in fitted.columns:
        open_folds = fitted.where(~F.col("converged")).select("symbol", "fold").limit(20).collect()
        if open_folds:
            warnings.warn(f"{strategy.name}: the fit did not converge in " + ", ".join(f"{x.symbol} fold {x.fold}" for x in open_folds), RuntimeWarning, stacklevel=2)
    if check and done.isEmpty():
        raise ValueError(f"{strategy.name}: no trade in any fold")
    metrics = bootstrap_p_values(calculate_metrics(executed, done), seed, resamples).drop("returns")
    described = fitted if isinstance(strategy, GridStrategy) else strategy.described(fitted)
    windows = (
        metrics.join(fold_table(bars, plan).drop("train_lo", "test_lo", "test_hi"), ["symbol", "fold"])
        .join(described.select("symbol", "fold", F.col("params").alias("active_params"), "label"), ["symbol", "fold"])
        .withColumn("skipped", F.lit(False))
        .persist()
    )
    returns = equity_returns(executed)
    test = test_rows(featured, plan)
    bh = buy_and_hold_returns(test, execution)
    candidates = None
    checks = windows.select("symbol", "strategy").distinct().select("*", number(NAN).alias("rc_cash"), number(NAN).alias("rc_bh"))
    if hasattr(strategy, "candidate_returns"):
        idle = windows.select("symbol", "fold", "flat_cash")
        zeroed = lambda c: F.when(F.col("flat_cash"), 0.0).otherwise(F.col(c))
        candidates = (
            strategy.candidate_returns(featured, fitted, plan).join(idle, ["symbol", "fold"]).join(bh.withColumnRenamed("r", "bh"), ["symbol", "fold", "t"])
            .select("symbol", "strategy", "fold", "cand_id", "t", zeroed("r").alias("r"), zeroed("bh").alias("bh"))
        )
        tested = reality_checks(candidate_matrix(candidates), seed, resamples, rc_parts)
        checks = checks.select("symbol", "strategy").join(tested, ["symbol", "strategy"], "left").select("symbol", "strategy", F.coalesce("rc_cash", number(NAN)).alias("rc_cash"), F.coalesce("rc_bh", number(NAN)).alias("rc_bh"))
    summary = (
        summarise(windows, returns).join(checks, ["symbol", "strategy"])
        .withColumnsRenamed({"rc_cash": "reality_check_p_value", "rc_bh": "reality_check_bh_p_value"})
        .join(compute_benchmark(windows, returns, test, execution), ["symbol", "strategy"], "left")
    )
    return Backtest(strategy.name, fitted, test, signals, executed, done, returns, windows, candidates, bh, summary, (fitted, executed, windows))
