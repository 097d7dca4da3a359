"""The public names, in one place.

Where a frame went in, a DataFrame with a ``symbol`` column goes in, so one call
covers any number of assets; where a loop ran over folds, candidates or costs,
one plan covers them all.
"""

from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.operators.benchmark import compute_benchmark
from stridefold.operators.execution import run_simulation, run_simulation_with_execution
from stridefold.operators.metrics import calculate_metrics
from stridefold.operators.resample import build_candidate_return_matrix, white_reality_check
from stridefold.operators.signals import returns_from_signals
from stridefold.plans.dashboard import build_dashboard
from stridefold.plans.models import Backtest as BacktestResult
from stridefold.plans.models import BenchmarkResult, MetricsResult, SimulationResult, Trade, WindowResult
from stridefold.plans.multi_asset import run_multi_asset
from stridefold.plans.strategies import BaseStrategy
from stridefold.plans.strategies import Kalman as KalmanFilterStrategy
from stridefold.plans.strategies import Momentum as MomentumStrategy
from stridefold.plans.strategies import MovingAverage as MovingAverageStrategy
from stridefold.plans.sweep import cost_sensitivity_sweep
from stridefold.plans.walk_forward import walk_forward
from stridefold.sources.bars import load_data, validate_data
from stridefold.sources.sinks import run_records, write_summary_csv, write_summary_json

__all__ = [
    "BacktestResult",
    "BaseStrategy",
    "BenchmarkResult",
    "ExecutionConfig",
    "FoldPlan",
    "KalmanFilterStrategy",
    "MetricsResult",
    "MomentumStrategy",
    "MovingAverageStrategy",
    "SimulationResult",
    "Trade",
    "WindowResult",
    "build_candidate_return_matrix",
    "build_dashboard",
    "calculate_metrics",
    "compute_benchmark",
    "cost_sensitivity_sweep",
    "load_data",
    "returns_from_signals",
    "run_multi_asset",
    "run_records",
    "run_simulation",
    "run_simulation_with_execution",
    "validate_data",
    "walk_forward",
    "white_reality_check",
    "write_summary_csv",
    "write_summary_json",
]
