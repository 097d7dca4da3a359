"""Trading rules. Native ones are indicators over shared columns; others run numpy or pandas per (symbol, fold)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import FoldPlan
from stridefold.functions.simplex import minimise
from stridefold.operators.folds import context_rows, counted, test_rows, train_rows
from stridefold.operators.metrics import sharpe

FITTED = "symbol string, strategy string, fold int, cand_id int, ctx int, params map<string,double>, label string"


def _ranked_first(frame: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class GridStrategy:
    """A rule whose position is an indicator, with a grid of candidates.

    ``featured`` adds ``f``, an array of numbers shared by all candidates and
    computed once per symbol over its whole series; fold-local warm-up is a mask
    on the row's place in its fold, so no earlier bar can leak in.
    """

    name: str = ""

    def features(self) -> list[Column]:
        raise NotImplementedError

    def grid(self) -> list[dict[str, int]]:
        """Candidates in order of preference among equals: cand_id, f1, f2, need (first valid place), least (fewest training bars), params."""
        raise NotImplementedError

    def up(self, c: Column) -> Column:
        raise NotImplementedError

    def featured(self, bars: DataFrame, plan: FoldPlan) -> DataFrame:
        w = Window.partitionBy("symbol").orderBy("ts")
        rows = counted(bars, plan).select("*", F.array(*self.features()).alias("f"))
        return rows.withColumn("next", F.try_divide(F.lead("close").over(w) - F.col("close"), F.col("close")))

    def candidates(self, train_bars: int) -> Column:
        usable = [g for g in self.grid() if train_bars >= g["least"]]
        if not usable:
            raise ValueError(f"{self.name}: no candidate can be evaluated on {train_bars} training bars")
        fields = ("cand_id", "f1", "f2", "need", "ctx")
        return F.array(*(F.struct(*(F.lit(g[k]).alias(k) for k in fields)) for g in usable))

    def grid_sharpes(self, featured: DataFrame, plan: FoldPlan) -> DataFrame:
        """(symbol, fold, cand_id, sharpe) on training parts, before costs."""
        rows = train_rows(featured, plan).where(F.col("j") < plan.train - 1).select("symbol", "fold", "j", "f", "next", F.explode(self.candidates(plan.train)).alias("c"))
        r = F.when((F.col("j") >= F.col("c.need")) & self.up(F.col("c")), F.coalesce(F.col("next"), F.lit(0.0))).otherwise(0.0)
        return rows.select("symbol", "fold", F.col("c.cand_id").alias("cand_id"), r.alias("r")).groupBy("symbol", "fold", "cand_id").agg(sharpe(F.col("r")).alias("sharpe"))

    def label(self, g: dict[str, int]) -> str:
        raise NotImplementedError

    def params(self, g: dict[str, int]) -> dict[str, float]:
        raise NotImplementedError

    def fit(self, featured: DataFrame, plan: FoldPlan) -> DataFrame:
        """The best candidate of each fold: the highest Sharpe, the first of the grid among equals."""
        best = _ranked_first(self.grid_sharpes(featured, plan), ["symbol", "fold"], F.desc("sharpe"), F.asc("cand_id"))
        known = F.array(
            *(
                F.struct(F.lit(g["ctx"]).alias("ctx"), F.create_map(*(F.lit(x) for k, v in self.params(g).items() for x in (k, float(v)))).alias("params"), F.lit(self.label(g)).alias("label"))
                for g in self.grid()
            )
        )
        return best.withColumn("_g", F.element_at(known, F.col("cand_id") + 1)).select("symbol", F.lit(self.name).alias("strategy"), "fold", "cand_id", "_g.ctx", "_g.params", "_g.label", "sharpe")

    def chosen(self, fitted: DataFrame) -> DataFrame:
        """Fitted folds with the numbers that ``up`` needs."""
        known = F.array(*(F.struct(F.lit(g["f1"]).alias("f1"), F.lit(g["f2"]).alias("f2")) for g in self.grid()))
        return fitted.withColumn("c", F.element_at(known, F.col("cand_id") + 1))

    def signals(self, featured: DataFrame, fitted: DataFrame, plan: FoldPlan) -> DataFrame:
        """(symbol, strategy, fold, t, ts, close, high, low, sig) of test parts, the context already taken into account."""
        w = Window.partitionBy("symbol", "fold").orderBy("t")
        rows = context_rows(featured, plan, 1).join(self.chosen(fitted).select("symbol", "fold", "c"), ["symbol", "fold"])
        rows = rows.withColumn("now", F.coalesce(self.up(F.col("c")), F.lit(False))).withColumn("was", F.coalesce(F.lag("now").over(w), F.lit(False)))
        first = F.when(F.col("now"), 1).when(F.col("was"), self.first_exit).otherwise(0)
        sig = F.when(F.col("t") == 0, first).otherwise(F.col("now").cast("int") - F.col("was").cast("int"))
        prices = [c for c in ("close", "high", "low") if c in featured.columns]
        return rows.where("t >= 0").select("symbol", F.lit(self.name).alias("strategy"), "fold", "t", "ts", *prices, sig.alias("sig"))

    first_exit = -1  # the signal of a first bar on which the indicator has just turned false

    def candidate_positions(self, featured: DataFrame, fitted: DataFrame, plan: FoldPlan) -> DataFrame:
        """(symbol, fold, cand_id, t, next, position) of every candidate on test parts, under the winner's context."""
        rows = test_rows(featured, plan).join(fitted.select("symbol", "fold", F.col("ctx").alias("own_ctx")), ["symbol", "fold"])
        rows = rows.select("symbol", "fold", "t", "f", "next", "own_ctx", F.explode(self.candidates(plan.train)).alias("c"))
        position = (F.col("t") >= F.col("c.need") - F.col("own_ctx")) & F.coalesce(self.up(F.col("c")), F.lit(False))
        return rows.select("symbol", "fold", F.col("c.cand_id").alias("cand_id"), "t", "next", position.alias("position"))

    def candidate_returns(self, featured: DataFrame, fitted: DataFrame, plan: FoldPlan) -> DataFrame:
        held = self.candidate_positions(featured, fitted, plan).where(F.col("t") < plan.test - 1)
        return held.select("symbol", F.lit(self.name).alias("strategy"), "fold", "cand_id", "t", F.when(F.col("position"), F.coalesce("next", F.lit(0.0))).otherwise(0.0).alias("r"))


@dataclass(frozen=True)
class MovingAverage(GridStrategy):
    """Long while the short mean of closes is above the long one by more than the rounding of their sums."""

    name: str = "moving_average"
    shorts: tuple[int, ...] = config.SHORT_WINDOWS
    longs: tuple[int, ...] = config.LONG_WINDOWS

    def windows(self) -> list[int]:
        return sorted(set(self.shorts) | set(self.longs))

    def features(self) -> list[Column]:
        w = Window.partitionBy("symbol").orderBy("ts")
        return [F.avg("close").over(w.rowsBetween(1 - n, 0)) for n in self.windows()]

    def grid(self) -> list[dict[str, int]]:
        at = {n: i for i, n in enumerate(self.windows())}
        pairs = [(s, n) for s in self.shorts for n in self.longs if s < n]
        return [{"cand_id": i, "f1": at[s], "f2": at[n], "need": n - 1, "least": n + 1, "ctx": n + 1, "short": s, "long": n} for i, (s, n) in enumerate(pairs)]

    def up(self, c: Column) -> Column:
        return F.col("f")[c["f1"]] > F.col("f")[c["f2"]] * (1 + config.EQUAL_MEANS)

    def label(self, g: dict[str, int]) -> str:
        return f"MA({g['short']}/{g['long']})"

    def params(self, g: dict[str, int]) -> dict[str, float]:
        return {"short_window": g["short"], "long_window": g["long"]}

    @classmethod
    def fixed(cls, short: int = config.DEFAULT_SHORT, long: int = config.DEFAULT_LONG) -> MovingAverage:
        if short >= long:
            raise ValueError(f"the short window ({short}) must be below the long one ({long})")
        return cls(shorts=(short,), longs=(long,))


@dataclass(frozen=True)
class Momentum(GridStrategy):
    """Long while the log return over the lookback is positive."""

    name: str = "momentum"
    lookbacks: tuple[int, ...] = config.LOOKBACKS
    first_exit = 0

    def __post_init__(self) -> None:
        if any(n <= 0 for n in self.lookbacks):
            raise ValueError("lookbacks must be positive")

    def features(self) -> list[Column]:
        w = Window.partitionBy("symbol").orderBy("ts")
        log = F.ln(F.greatest(F.col("close"), F.lit(1e-10)))
        return [log - F.lag(log, n).over(w) for n in self.lookbacks]

    def grid(self) -> list[dict[str, int]]:
        return [{"cand_id": i, "f1": i, "f2": i, "need": n, "least": n + 2, "ctx": n, "lookback": n} for i, n in enumerate(self.lookbacks)]

    def up(self, c: Column) -> Column:
        return F.col("f")[c["f1"]] > 0

    def label(self, g: dict[str, int]) -> str:
        return f"MOM({g['lookback']})"

    def params(self, g: dict[str, int]) -> dict[str, float]:
        return {"lookback": g["lookback"]}

    def candidate_positions(self, featured: DataFrame, fitted: DataFrame, plan: FoldPlan) -> DataFrame:
        """A candidate shorter than the context bought inside it, so a run that was on at the context's last bar is lost."""
        rows = context_rows(featured, plan, 1).join(fitted.select("symbol", "fold", F.col("ctx").alias("own_ctx")), ["symbol", "fold"])
        rows = rows.select("symbol", "fold", "t", "f", "next", "own_ctx", F.explode(self.candidates(plan.train)).alias("c"))
        rows = rows.select("symbol", "fold", F.col("c.cand_id").alias("cand_id"), F.col("c.need").alias("need"), "t", "next", "own_ctx", F.coalesce(self.up(F.col("c")), F.lit(False)).alias("up"))
        flat_at = F.min(F.when(~F.col("up"), F.col("t"))).over(Window.partitionBy("symbol", "fold", "cand_id"))
        rows = rows.withColumn("flat_at", flat_at).where("t >= 0")
        lost = (F.col("need") < F.col("own_ctx")) & (F.col("flat_at").isNull() | (F.col("t") < F.col("flat_at")))
        position = F.col("up") & (F.col("t") >= F.col("need") - F.col("own_ctx")) & ~lost
        return rows.select("symbol", "fold", "cand_id", "t", "next", position.alias("position"))

    @classmethod
    def fixed(cls, lookback: int) -> Momentum:
        return cls(lookbacks=(lookback,))


def kalman_log_likelihood(y: np.ndarray, q: float, r: float) -> float:
    """Gaussian log-likelihood of the local-level model; variances are floored at MIN_VARIANCE."""
    q, r = max(q, config.MIN_VARIANCE), max(r, config.MIN_VARIANCE)
    values = y.tolist()
    level, p, error, spread = values[0], 1.0, [], []
    for v in values:
        p += q
        s = p + r
        e = v - level
        error.append(e)
        spread.append(s)
        k = p / s
        level += k * e
        p *= 1.0 - k
    s = np.array(spread)
    return float(-0.5 * (np.log(2 * np.pi * s) + np.array(error) ** 2 / s).sum())


def kalman_filter(y: np.ndarray, q: float, r: float, warm_up: int = config.WARM_UP) -> np.ndarray:
    """Filtered level: exact gains for the first bars, the steady-state gain after them."""
    if not len(y):
        return np.zeros(0)
    x = (q + np.sqrt(q * q + 4 * q * r)) / 2
    steady = x / (x + r)
    level, p, out = float(y[0]), 1.0, np.empty(len(y))
    for t, v in enumerate(y.tolist()):
        if t < warm_up:
            p += q
            k = p / (p + r)
            p *= 1.0 - k
        else:
            k = steady
        level += k * (v - level)
        out[t] = level
    return out


def kalman_mle(closes: np.ndarray) -> tuple[float, float, float, bool]:
    """(q, r, log-likelihood, converged) by Nelder-Mead in the logs of both variances."""
    y = np.log(np.asarray(closes, float))

    def loss(z: np.ndarray) -> float:
        with np.errstate(over="ignore"):
            value = kalman_log_likelihood(y, float(np.exp(z[0])), float(np.exp(z[1])))
        return -value if np.isfinite(value) else 1e10

    best, value, converged, _ = minimise(loss, np.log([config.Q_START, config.R_START]), config.X_TOL, config.F_TOL, config.MAX_STEPS)
    q, r = (max(float(np.exp(v)), config.MIN_VARIANCE) for v in best)
    return q, r, -value, converged


@dataclass(frozen=True)
class Kalman:
    """Long while the filtered log price rises; variances by maximum likelihood, or given. No candidates, so no Reality Check."""

    name: str = "kalman"
    q: float | None = None
    r: float | None = None
    context: int = config.WARM_UP

    def featured(self, bars: DataFrame, plan: FoldPlan) -> DataFrame:
        return counted(bars, plan)

    def run(self, featured: DataFrame, plan: FoldPlan) -> DataFrame:
        """One row a fold: q, r, snr, log_likelihood, converged and the test signals. A fold's closes travel as two arrays."""
        train = train_rows(featured, plan).select("symbol", "fold", (F.col("j") - plan.train).alias("t"), "close", F.lit(True).alias("fit"))
        test = context_rows(featured, plan, self.context).select("symbol", "fold", "t", "close", F.lit(False).alias("fit"))
        ordered = lambda keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("t", "close")))), lambda x: x.close)
        folds = train.unionByName(test).groupBy("symbol", "fold").agg(ordered(F.col("fit")).alias("train"), ordered(~F.col("fit")).alias("test"))
        q0, r0, n = self.q, self.r, plan.test

        @F.pandas_udf("q double, r double, snr double, log_likelihood double, converged boolean, sig array<int>, level array<double>")
        def fitted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for trains, tests in batches:
                out = []
                for x, z in zip(trains, tests):
                    if q0 is None or r0 is None:
                        q, r, ll, ok = kalman_mle(x)
                    else:
                        q, r, ok = q0, r0, True
                        ll = kalman_log_likelihood(np.log(np.asarray(x, float)), q, r)
                    level = kalman_filter(np.log(np.asarray(z, float)), q, r)
                    sig, level = kalman_signals(level, len(level) - n), level[len(level) - n :]
                    out.append((q, r, q / max(r, 1e-300), ll, ok, sig.tolist(), level.tolist()))
                yield pd.DataFrame(out, columns=["q", "r", "snr", "log_likelihood", "converged", "sig", "level"])

        return folds.withColumn("k", fitted("train", "test")).select("symbol", "fold", "k.*")

    def fit(self, featured: DataFrame, plan: FoldPlan) -> DataFrame:
        return self.run(featured, plan)

    @staticmethod
    def described(run: DataFrame) -> DataFrame:
        params = F.map_from_arrays(F.array(*(F.lit(k) for k in ("q", "r", "snr", "log_likelihood"))), F.array("q", "r", "snr", "log_likelihood"))
        return run.select("symbol", F.lit("kalman").alias("strategy"), "fold", F.lit(-1).alias("cand_id"), F.lit(config.WARM_UP).alias("ctx"), params.alias("params"), F.format_string("SNR=%.2e", "snr").alias("label"))

    def signals(self, featured: DataFrame, fitted: DataFrame, plan: FoldPlan) -> DataFrame:
        sig = fitted.select("symbol", "fold", F.posexplode("sig").alias("t", "sig"))
        prices = [c for c in ("close", "high", "low") if c in featured.columns]
        return test_rows(featured, plan).join(sig, ["symbol", "fold", "t"]).select("symbol", F.lit(self.name).alias("strategy"), "fold", "t", "ts", *prices, "sig")


def kalman_signals(level: np.ndarray, context: int) -> np.ndarray:
    """Crossings of the level's change through zero on the bars after the context; a rise that was on before them is bought at their first bar."""
    up = (np.diff(level, prepend=level[:1]) > 0).astype(int)
    sig = np.diff(up, prepend=up[:1])
    out = sig[context:].copy()
    if 0 < context < len(level) and up[context - 1] and out[0] == 0 and len(out):
        out[0] = 1
    return out


class BaseStrategy:
    """Subclass this for a rule of your own; it sees pandas frames of one symbol's bars, indexed by time.

    A copy is made for every fold, so nothing can leak from one to the next.
    """

    name = "custom"

    def fit(self, train: pd.DataFrame) -> BaseStrategy:
        raise NotImplementedError

    def generate_signals(self, data: pd.DataFrame) -> pd.Series:
        raise NotImplementedError

    def generate_signals_with_context(self, context: pd.DataFrame, test: pd.DataFrame) -> pd.Series:
        return self.generate_signals(test)

    def candidate_test_returns(self, context: pd.DataFrame, test: pd.DataFrame) -> dict[Any, pd.Series]:
        return {}

    def active_params(self) -> dict[str, float]:
        return {}

    def format_params(self) -> str:
        own = self.active_params()
        return str(own) if own else ""

    def param_evolution_spec(self) -> list[tuple[str, str]]:
        return [(k, k) for k in self.active_params()]

    def context_window_size(self) -> int:
        return 50


@dataclass(frozen=True)
class Custom:
    """Runs a BaseStrategy on every (symbol, fold) in a task of its own."""

    strategy: BaseStrategy

    @property
    def name(self) -> str:
        return self.strategy.name

    def featured(self, bars: DataFrame, plan: FoldPlan) -> DataFrame:
        return counted(bars, plan)

    def fit(self, featured: DataFrame, plan: FoldPlan) -> DataFrame:
        """Rows (symbol, fold, t, sig, cand, r, params, label): signals have no cand, candidate returns have one."""
        import copy

        prices = [c for c in ("close", "high", "low", "volume") if c in featured.columns]
        train = train_rows(featured, plan).select("symbol", "fold", (F.col("j") - plan.train).alias("t"), "ts", *prices)
        rows = train.unionByName(test_rows(featured, plan).select("symbol", "fold", "t", "ts", *prices))
        model = self.strategy

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t").reset_index(drop=True)
            own, frame = copy.deepcopy(model), pdf.set_index("ts")[prices]
            past = frame[(pdf["t"] < 0).to_numpy()]
            test = frame[(pdf["t"] >= 0).to_numpy()]
            own.fit(past)
            n = own.context_window_size()
            context = past.iloc[-n:] if n > 0 else past.iloc[:0]
            sig = np.asarray(own.generate_signals_with_context(context, test))
            if len(sig) != len(test) or not np.isin(sig, (-1, 0, 1)).all():
                raise ValueError(f"{own.name}: signals must be -1, 0 or 1, one a bar")
            params, label = {k: float(v) for k, v in own.active_params().items()}, own.format_params()
            out = [(None, t, int(s), None) for t, s in enumerate(sig)]
            for key, r in own.candidate_test_returns(context, test).items():
                out += [(str(key), t, None, float(x)) for t, x in enumerate(np.asarray(r, float))]
            done = pd.DataFrame(out, columns=["cand", "t", "sig", "r"])
            done.insert(0, "symbol", pdf["symbol"].iloc[0])
            done.insert(1, "fold", pdf["fold"].iloc[0])
            done["params"], done["label"] = [params] * len(done), label
            return done

        return rows.groupBy("symbol", "fold").applyInPandas(run, "symbol string, fold int, cand string, t int, sig int, r double, params map<string,double>, label string")

    def described(self, run: DataFrame) -> DataFrame:
        own = run.where("cand is null and t = 0")
        return own.select("symbol", F.lit(self.name).alias("strategy"), "fold", F.lit(-1).alias("cand_id"), F.lit(self.strategy.context_window_size()).alias("ctx"), "params", "label")

    def signals(self, featured: DataFrame, fitted: DataFrame, plan: FoldPlan) -> DataFrame:
        prices = [c for c in ("close", "high", "low") if c in featured.columns]
        sig = fitted.where("cand is null").select("symbol", "fold", "t", "sig")
        return test_rows(featured, plan).join(sig, ["symbol", "fold", "t"]).select("symbol", F.lit(self.name).alias("strategy"), "fold", "t", "ts", *prices, "sig")

    def candidate_returns(self, featured: DataFrame, fitted: DataFrame, plan: FoldPlan) -> DataFrame:
        """A symbol's candidates are numbered in the order of their names."""
        own = fitted.where("cand is not null")
        ids = own.select("symbol", "cand").distinct().withColumn("cand_id", F.row_number().over(Window.partitionBy("symbol").orderBy("cand")) - 1)
        return own.join(ids, ["symbol", "cand"]).select("symbol", F.lit(self.name).alias("strategy"), "fold", "cand_id", "t", "r")
