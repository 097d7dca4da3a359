"""Fixed values of the method, and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

INITIAL_VALUE = 100_000.0
SIZE_FRACTION = 1.0
COST_RATE = 0.001
TRAIN_YEARS, TEST_YEARS = 3, 1
BARS_PER_YEAR = 252
RISK_FREE = 0.0
RESAMPLES = 10_000
SIGNIFICANCE = 0.05
SEED = 7919
TICKER, START = "SPY", "1993-01-01"
MULTI_TICKERS, MULTI_START = ("SPY", "QQQ", "TLT", "GLD"), "2005-01-01"
SHORT_WINDOWS = tuple(range(20, 81, 10))
LONG_WINDOWS = tuple(range(100, 251, 10))
DEFAULT_SHORT, DEFAULT_LONG = 50, 200
LOOKBACKS = (20, 40, 60, 90, 120, 180, 250)
MIN_VARIANCE, X_TOL, F_TOL, MAX_STEPS = 1e-8, 1e-6, 1e-6, 2000
Q_START, R_START, WARM_UP = 1e-4, 1e-2, 50
SWEEP_COSTS = (1e-4, 5e-4, 1e-3, 2e-3, 5e-3)
SWEEP_SLIPPAGES = (0.0, 0.025, 0.05, 0.1, 0.2)
CACHE_HOURS, CACHE_HOURS_FIXED_END, ATTEMPTS, CLIP_TOLERANCE = 24, 365 * 24, 3, 0.005
FLAT_STD = 1e-10
EQUAL_MEANS = 1e-12  # relative: far above the rounding of a window's sum, far below any difference of prices


@dataclass(frozen=True)
class ExecutionConfig:
    """Cost per side, share of the bar's range lost per fill, bars between signal and fill."""

    transaction_cost_rate: float = COST_RATE
    slippage_factor: float = 0.05
    signal_delay: int = 1

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if value < 0:
                raise ValueError(f"{name} must not be negative, got {value}")


@dataclass(frozen=True)
class FoldPlan:
    """Lengths in bars; years are only a way to state them."""

    train: int = TRAIN_YEARS * BARS_PER_YEAR
    test: int = TEST_YEARS * BARS_PER_YEAR

    def __post_init__(self) -> None:
        if self.train <= 0 or self.test <= 0:
            raise ValueError("training and test lengths must be positive")

    @classmethod
    def years(cls, train: int = TRAIN_YEARS, test: int = TEST_YEARS) -> FoldPlan:
        return cls(train * BARS_PER_YEAR, test * BARS_PER_YEAR)

    @property
    def min_rows(self) -> int:
        return self.train + self.test
