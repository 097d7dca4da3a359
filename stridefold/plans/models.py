"""What a run returns: schemas of the tables, and a handle on a finished backtest."""

from __future__ import annotations

from dataclasses import dataclass, field, make_dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

#: Rows of ``trades``, ``executed``, ``windows`` and ``summary``.
TRADE = "entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, shares double, transaction_costs double, pnl double"
METRICS = (
    "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "omega_ratio", "p_value", "combined_p_value", "reality_check_p_value",
    "reality_check_bh_p_value", "exposure_fraction", "trade_count", "win_rate", "avg_win_loss_ratio", "avg_holding_days",
)
BENCHMARK = (
    "benchmark_sharpe", "benchmark_sortino", "benchmark_max_drawdown", "information_ratio", "sharpe_diff_t_stat", "sharpe_diff_p_value",
    "strategy_beats_benchmark_fraction",
)


@dataclass(frozen=True)
class Trade:
    """A row of ``trades``: one round trip, costs of both sides included."""

    entry_ts: datetime
    exit_ts: datetime
    entry_price: float
    exit_price: float
    shares: float
    transaction_costs: float
    pnl: float


@dataclass(frozen=True)
class SimulationResult:
    """Round trips and equity by bar (t, ts, equity) of one window."""

    trades: DataFrame
    portfolio_values: DataFrame

    def trade_list(self) -> list[Trade]:
        names = list(Trade.__dataclass_fields__)
        return [Trade(*r) for r in self.trades.orderBy("entry_ts").select(*names).collect()]


#: All metrics of a window or a run; NaN where one is undefined, or tested only for whole runs.
MetricsResult = make_dataclass("MetricsResult", [(n, float, field(default=float("nan"))) for n in METRICS], frozen=True, module=__name__)
#: A run against buy and hold.
BenchmarkResult = make_dataclass("BenchmarkResult", [(n, float, field(default=float("nan"))) for n in BENCHMARK], frozen=True, module=__name__)


@dataclass(frozen=True)
class WindowResult:
    """A row of ``windows`` with the part of the run's tables that belongs to it."""

    train_start: datetime
    train_end: datetime
    test_start: datetime
    test_end: datetime
    simulation_result: SimulationResult
    metrics_result: MetricsResult
    active_params: dict[str, float]
    formatted_params: str
    skipped: bool = False


def picked(kind: type, row: dict[str, Any]) -> Any:
    return kind(**{n: row[n] for n in kind.__dataclass_fields__ if row.get(n) is not None})


@dataclass(frozen=True)
class Backtest:
    """Lazily evaluated tables of one strategy over all symbols and folds.

    fitted: parameters by fold. executed: equity by bar. trades: round trips.
    windows: metrics by fold, with dates, parameters and label (``skipped`` is
    always false). candidates: returns of every candidate, zero in folds without
    trades. summary: one row a run. A run keeps the frames that several of these
    share; ``close`` (or leaving a ``with`` block) frees them.
    """

    name: str
    fitted: DataFrame
    test: DataFrame
    signals: DataFrame
    executed: DataFrame
    trades: DataFrame
    returns: DataFrame
    windows: DataFrame
    candidates: DataFrame | None
    bh: DataFrame
    summary: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Free what the run keeps in memory and on disk; its tables can still be read, and are computed anew."""
        for frame in self.kept:
            frame.unpersist()

    def __enter__(self) -> Backtest:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def param_evolution(self) -> DataFrame:
        """(symbol, fold, key, value), for plots of how parameters move."""
        from pyspark.sql import functions as F

        return self.fitted.select("symbol", "strategy", "fold", F.explode("params").alias("key", "value"))

    def window_results(self, symbol: str) -> list[WindowResult]:
        """The folds of one symbol, on the driver; their trades and equity stay frames."""
        from pyspark.sql import functions as F

        own = lambda frame, fold: frame.where((F.col("symbol") == symbol) & (F.col("fold") == fold))
        out = []
        for r in self.windows.where(F.col("symbol") == symbol).orderBy("fold").collect():
            run = SimulationResult(own(self.trades, r.fold), own(self.executed, r.fold).select("t", "ts", "equity"))
            out.append(WindowResult(r.train_start, r.train_end, r.test_start, r.test_end, run, picked(MetricsResult, r.asDict()), r.active_params, r.label, r.skipped))
        return out

    def summary_metrics(self, symbol: str) -> MetricsResult:
        return next(picked(MetricsResult, r) for r in self.rows() if r["symbol"] == symbol)

    def benchmark_metrics(self, symbol: str) -> BenchmarkResult:
        return next(picked(BenchmarkResult, r) for r in self.rows() if r["symbol"] == symbol)

    def rows(self) -> list[dict[str, Any]]:
        """The summary on the driver: a row a symbol."""
        return [r.asDict(recursive=True) for r in self.summary.orderBy("symbol").collect()]
