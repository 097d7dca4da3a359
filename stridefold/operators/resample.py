"""Resampling tests in numpy behind Arrow: the block bootstrap of a Sharpe ratio and White's Reality Check.

Both keep numpy's PCG64 stream, so their p-values equal those of a plain loop
over resamples; prefix sums replace the gathering of every resample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefold import config

YEAR = np.sqrt(config.BARS_PER_YEAR)
CHUNK = 500
#: Of a number of periods, the draws (starts, lengths, where each resample begins) of all resamples.
Draws = Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]


@lru_cache(8)
def _starts(n: int, count: int, seed: int) -> np.ndarray:
    """Block starts; folds of equal length share them."""
    blocks = n // max(1, int(np.sqrt(n))) + 1
    return np.random.default_rng(seed).integers(0, n, (count, blocks))


def sharpe_ratio(r: np.ndarray) -> float:
    spread = r.std(ddof=1) if len(r) > 1 else 0.0
    return 0.0 if spread < config.FLAT_STD else float(r.mean() / spread * YEAR)


def block_bootstrap_p(returns: np.ndarray, seed: int = config.SEED, count: int = config.RESAMPLES, starts: np.ndarray | None = None) -> float:
    """Share of circular block resamples of the centred returns with a Sharpe ratio at or above the observed.

    ``starts`` (a row a resample, a column a block) replaces the stream's own.
    """
    r = np.asarray(returns, float)
    n = len(r)
    if n == 0:
        raise ValueError("no returns")
    size = max(1, int(np.sqrt(n)))
    starts = _starts(n, count, seed) if starts is None else starts
    lengths = np.minimum(size, n - size * np.arange(starts.shape[1]))  # the last block is cut at n
    x = np.tile(r - r.mean(), 2)
    first, second = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
    mean = (first[starts + lengths] - first[starts]).sum(1) / n
    power = (second[starts + lengths] - second[starts]).sum(1)
    spread = np.sqrt(np.maximum(power - n * mean * mean, 0.0) / max(n - 1, 1))
    flat = spread < config.FLAT_STD
    booted = np.where(flat, 0.0, (mean - config.RISK_FREE) / np.where(flat, 1.0, spread)) * YEAR
    return float((booted >= sharpe_ratio(r - config.RISK_FREE)).mean())


def bootstrap_p_values(metrics: DataFrame, seed: int = config.SEED, count: int = config.RESAMPLES, starts: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """Adds ``p_value`` to rows with ``returns``: 1 for flat folds. A fold is a row, so folds run in parallel."""

    @F.pandas_udf("double")
    def tested(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for returns, flat in batches:
            yield pd.Series([1.0 if f or r is None else block_bootstrap_p(np.asarray(r, float), seed, count, starts(len(r)) if starts else None) for r, f in zip(returns, flat)])

    return metrics.withColumn("p_value", tested("returns", "flat_cash"))


@lru_cache(4)
def stationary_draws(periods: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the blocks of all resamples, in the order in which one stream draws them, and where each resample begins."""
    rng = np.random.default_rng(seed)
    p = 1.0 / max(1, int(np.sqrt(periods)))
    starts, lengths, heads = [], [], []
    integers, geometric = rng.integers, rng.geometric
    for _ in range(count):
        heads.append(len(starts))
        left = periods
        while left > 0:
            starts.append(int(integers(0, periods)))
            n = min(int(geometric(p)), left)
            lengths.append(n)
            left -= n
    return np.array(starts), np.array(lengths), np.array(heads)


def part_of(draws: tuple[np.ndarray, np.ndarray, np.ndarray], part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The draws of one part of the resamples; all parts together are all of them."""
    starts, lengths, heads = draws
    lo, hi = len(heads) * part // parts, len(heads) * (part + 1) // parts
    begin, end = (int(np.append(heads, len(starts))[i]) for i in (lo, hi))
    return starts[begin:end], lengths[begin:end], heads[lo:hi] - begin


@lru_cache(4)
def hashed_starts(periods: int, blocks: int, count: int) -> np.ndarray:
    """Block starts by md5 of "resample_block", the same in any engine."""
    return np.array([[int(md5(f"{b}_{k}".encode()).hexdigest()[:8], 16) % periods for k in range(blocks)] for b in range(count)])


def hashed_draws(periods: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the square root of the periods at hashed starts; the last one is cut at their number."""
    size = max(1, int(np.sqrt(periods)))
    blocks = -(-periods // size)
    lengths = np.minimum(size, periods - size * np.arange(blocks))
    return hashed_starts(periods, blocks, count).ravel(), np.tile(lengths, count), blocks * np.arange(count)


def resampled_means(matrix: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> Iterator[np.ndarray]:
    """Column means of the resamples, some hundred at a time."""
    periods = len(matrix)
    sums = np.concatenate([np.zeros((1, matrix.shape[1])), np.cumsum(np.tile(matrix, (2, 1)), 0)])
    ends = np.append(heads[1:], len(starts))
    for at in range(0, len(heads), CHUNK):
        lo, hi = heads[at], ends[min(at + CHUNK, len(heads)) - 1]
        s = starts[lo:hi]
        yield np.add.reduceat(sums[s + lengths[lo:hi]] - sums[s], heads[at : at + CHUNK] - lo, axis=0) / periods


def white_reality_check(candidates: np.ndarray, seed: int = config.SEED, n_bootstrap: int | None = None, benchmark: np.ndarray | None = None, draws=None) -> float:
    """p of the best candidate's mean under the joint null, by the stationary bootstrap of a (periods x candidates) matrix."""
    m = np.asarray(candidates, float)
    if m.ndim != 2:
        raise ValueError(f"candidates must be a matrix, got shape {m.shape}")
    if m.shape[1] < 1:
        raise ValueError("no candidate")
    if len(m) < 2:
        raise ValueError("two periods at least are needed")
    if benchmark is not None:
        bench = np.asarray(benchmark, float).ravel()
        if len(bench) != len(m):
            raise ValueError(f"benchmark has {len(bench)} periods, candidates have {len(m)}")
        m = m - bench[:, None]
    mean = m.mean(0)
    if draws is not None and not len(draws[2]):
        return 0.0
    draws = draws or stationary_draws(len(m), config.RESAMPLES if n_bootstrap is None else n_bootstrap, seed)
    hits = sum(int(((x - mean).max(1) >= mean.max()).sum()) for x in resampled_means(m, *draws))
    return hits / len(draws[2])


def candidate_matrix(returns: DataFrame, keys: Sequence[str] = ("symbol", "strategy")) -> DataFrame:
    """Candidates that every fold of their run has, each with its returns in order: (keys, cand_id, n_periods, r).

    An array holds one candidate's bars over all folds; candidates are rows.
    """
    folds = returns.groupBy(*keys).agg(F.count_distinct("fold").alias("all_folds"))
    whole = returns.groupBy(*keys, "cand_id").agg(F.count_distinct("fold").alias("folds"), F.sort_array(F.collect_list(F.struct("fold", "t", "r", "bh"))).alias("x"))
    return whole.join(folds, list(keys)).where("folds = all_folds").select(*keys, "cand_id", F.size("x").alias("n_periods"), F.transform("x", lambda v: v.r).alias("r"), F.transform("x", lambda v: v.bh).alias("bh"))


def reality_checks(candidates: DataFrame, seed: int = config.SEED, count: int = config.RESAMPLES, parts: int = 1, draws: Draws | None = None) -> DataFrame:
    """(symbol, strategy, rc_cash, rc_bh): both nulls for each run; NaN where no candidate can be tested.

    The draws are those of one stream, or of ``draws``; ``parts`` tasks of a run
    make them alike and each tests its part of the resamples, so that the result
    does not depend on their number.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cand_id")
        matrix, bench = np.stack(pdf["r"].map(np.asarray).tolist(), 1), np.asarray(pdf["bh"].iloc[0], float)
        part, out = int(pdf["part"].iloc[0]), {"n": 0}
        for name, null in (("rc_cash", None), ("rc_bh", bench)):
            try:
                own = part_of(draws(len(matrix)) if draws else stationary_draws(len(matrix), count, seed), part, parts) if len(matrix) else None
                out["n"] = len(own[2]) if own else 0
                out[name] = white_reality_check(matrix, seed, count, null, own) * out["n"]
            except ValueError:
                out[name] = float("nan")
        return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], "strategy": pdf["strategy"].iloc[0], **out}])

    rows = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tested = rows.groupBy("symbol", "strategy", "part").applyInPandas(run, "symbol string, strategy string, n long, rc_cash double, rc_bh double")
    share = lambda c: F.when(F.sum("n") > 0, F.round(F.sum(c)) / F.sum("n")).otherwise(F.sum(c))  # noqa: E731  counts are whole
    return tested.groupBy("symbol", "strategy").agg(share("rc_cash").alias("rc_cash"), share("rc_bh").alias("rc_bh"))


def build_candidate_return_matrix(folds: Sequence[dict]) -> np.ndarray:
    """The same from dictionaries in memory: keys common to all folds, sorted, folds end to end."""
    if not folds:
        raise ValueError("no folds")
    common = sorted(set(folds[0]).intersection(*folds[1:]))
    if not common:
        raise ValueError("no candidate in every fold")
    return np.concatenate([np.stack([np.asarray(f[k], float) for k in common], 1) for f in folds])
