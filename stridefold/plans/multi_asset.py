"""Many assets and strategies; an asset that fails validation is left out and named."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.plans.models import Backtest
from stridefold.plans.strategies import Kalman, Momentum, MovingAverage
from stridefold.plans.walk_forward import walk_forward
from stridefold.sources.bars import validation_report

STRATEGIES = {"ma": MovingAverage, "kalman": Kalman, "momentum": Momentum}


def usable(bars: DataFrame, plan: FoldPlan) -> tuple[DataFrame, DataFrame]:
    """Bars of the symbols that pass, and a table (symbol, reason) of the others."""
    skipped = validation_report(bars, plan.min_rows).where("reason is not null").select("symbol", "reason")
    return bars.join(skipped.select("symbol"), "symbol", "left_anti"), skipped


def run_multi_asset(
    bars: DataFrame, strategies: Sequence[str] | Mapping[str, Any] = ("ma",), plan: FoldPlan | None = None, execution: ExecutionConfig | None = None, *, seed: int = config.SEED, resamples: int = config.RESAMPLES
) -> tuple[Mapping[str, Backtest], DataFrame, DataFrame]:
    """Backtests by strategy (names, or a mapping of names to strategies), their summaries in one table, and the symbols left out."""
    own = strategies if isinstance(strategies, Mapping) else {n: STRATEGIES[n]() for n in strategies if n in STRATEGIES}
    if unknown := sorted(set(strategies) - set(own)):
        raise ValueError(f"unknown strategies: {unknown}; there are {sorted(STRATEGIES)}")
    plan = plan or FoldPlan()
    good, skipped = usable(bars, plan)
    runs = {name: walk_forward(good, rule, plan, execution, seed=seed, resamples=resamples, check=False) for name, rule in own.items()}
    table: DataFrame | None = None
    for run in runs.values():
        traded = run.summary.where("trade_count > 0")
        table = traded if table is None else table.unionByName(traded)
    return runs, comparison(table, len(own) > 1), skipped


def comparison(summary: DataFrame, many: bool) -> DataFrame:
    """Run keys as ``symbol`` or ``symbol:strategy``, and whether Fisher's p is significant."""
    key = F.concat_ws(":", "symbol", "strategy") if many else F.col("symbol")
    return summary.withColumn("run", key).withColumn("significant", F.col("combined_p_value") < config.SIGNIFICANCE)


def overall(table: DataFrame) -> str:
    n, hits = table.agg(F.count("*"), F.count_if("significant")).first()
    if not n:
        return "no run succeeded"
    return "no run is significant" if not hits else "all runs are significant" if hits == n else f"{hits} of {n} runs are significant: mixed evidence"
