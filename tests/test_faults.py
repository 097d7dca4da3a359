"""What an earlier version got wrong: custom rules, scales of prices, draws, warnings, files."""

import json
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bars, oscillating
from stridefold import api, cli
from stridefold.config import FoldPlan
from stridefold.operators.resample import block_bootstrap_p, candidate_matrix, hashed_draws, hashed_starts, part_of, reality_checks, stationary_draws, white_reality_check
from stridefold.plans import strategies
from stridefold.plans.strategies import BaseStrategy, Kalman, MovingAverage, kalman_log_likelihood, kalman_mle
from stridefold.plans.walk_forward import walk_forward

PLAN = FoldPlan(252, 252)


def seen(n):
    """Buys at once; its parameter is the number of context bars; candidates have long names."""

    class Seen(BaseStrategy):  # made here, so that it travels to the workers by value
        name, context = "seen", n

        def fit(self, train):
            return self

        def context_window_size(self):
            return self.context

        def generate_signals_with_context(self, context, test):
            self.got = len(context)
            return pd.Series([1] + [0] * (len(test) - 1), index=test.index)

        def candidate_test_returns(self, context, test):
            return {f"candidate {k}": pd.Series(np.full(len(test) - 1, k * 1e-4)) for k in range(30)}

        def active_params(self):
            return {"got": float(getattr(self, "got", -1))}

    return Seen()


@pytest.mark.parametrize("context, got", [(50, 50), (300, 252), (0, 0)])
def test_custom_context(spark, context, got):
    data = bars(spark, oscillating(504))
    with walk_forward(data, seen(context), PLAN, resamples=20) as run:
        fold = run.windows.first()
        ids = [r.cand_id for r in run.candidates.select("cand_id").distinct().collect()]
        assert sorted(ids) == list(range(30)) and run.rows()[0]["reality_check_p_value"] >= 0
        assert run.kept and all(f.is_cached for f in run.kept)
    assert not any(f.is_cached for f in run.kept)
    # parameters are read after the signals
    assert fold.active_params["got"] == got


def test_any_scale_of_prices(spark):
    """Prices a hundred billion times smaller or larger cross at the same bars; equal prices never do."""
    rule, counts = MovingAverage.fixed(20, 100), []
    for scale in (1e-11, 1.0, 1e11):
        data = bars(spark, oscillating(504) * scale, spread=0.5 * scale)
        featured = rule.featured(data, PLAN)
        every = featured.where("i >= 252").groupBy("symbol").agg(F.lit(0).alias("fold"), F.lit(0).alias("cand_id"))
        counts.append(sorted((r.t, r.sig) for r in rule.signals(featured, every, PLAN).where("sig <> 0").collect()))
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) > 3
    flat = rule.featured(bars(spark, np.full(504, 0.1)), PLAN)
    assert flat.where(rule.up({"f1": 0, "f2": 1})).count() == 0


def test_draws_in_parts_and_by_hash(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(0, 0.01, (90, 4))
    draws = stationary_draws(90, 101, 5)
    own = [part_of(draws, k, 7) for k in range(7)]
    assert sum(len(x[2]) for x in own) == 101 and np.concatenate([x[0] for x in own]).tolist() == draws[0].tolist()
    total = sum(white_reality_check(m, draws=x) * len(x[2]) for x in own)
    assert total == pytest.approx(white_reality_check(m, 5, 101) * 101)
    rows = [("X", "s", f, c, t, float(m[45 * f + t, c]), 0.001 * t) for f in range(2) for c in range(4) for t in range(45)]
    matrix = candidate_matrix(spark.createDataFrame(rows, "symbol string, strategy string, fold int, cand_id int, t int, r double, bh double"))
    one, many = (reality_checks(matrix, 5, 101, parts).first() for parts in (1, 7))
    assert one == many and one.rc_cash == pytest.approx(total / 101)
    starts, lengths, heads = hashed_draws(90, 20)
    assert lengths.reshape(20, -1).sum(1).tolist() == [90] * 20 and heads.tolist() == list(range(0, 200, 10)) and 0 <= starts.min() and starts.max() < 90


def test_stationary_draws_equal_a_plain_loop():
    """The draws by a loop of their own: a start, then a geometric length, cut where the periods end."""
    rng = np.random.default_rng(9)
    starts, lengths, heads = stationary_draws(70, 30, 9)
    plain = []
    for _ in range(30):
        path = []
        while len(path) < 70:
            begin, n = rng.integers(0, 70), rng.geometric(1 / 8)
            path += [(begin + k) % 70 for k in range(n)]
        plain.append(path[:70])
    ends = np.append(heads[1:], len(starts))
    assert [[(s + k) % 70 for s, n in zip(starts[a:z], lengths[a:z]) for k in range(n)] for a, z in zip(heads, ends)] == plain


def test_block_bootstrap_of_given_starts():
    r = np.random.default_rng(2).normal(0.0004, 0.01, 120)
    starts = hashed_starts(120, 12, 300)
    x, hits = r - r.mean(), 0
    for s in starts:
        path = np.concatenate([(np.arange(10) + b) % 120 for b in s])[:120]
        hits += x[path].mean() / x[path].std(ddof=1) >= r.mean() / r.std(ddof=1)
    assert block_bootstrap_p(r, starts=starts) == pytest.approx(hits / 300)


def test_kalman_optimum_and_warning(spark, monkeypatch):
    """The fitted variances are near the best of a fine grid, and a fit that does not converge is named."""
    closes = 100 * np.exp(np.cumsum(np.random.default_rng(42).normal(0, 0.01, 400)) + np.random.default_rng(1).normal(0, 0.01, 400))
    q, r, ll, ok = kalman_mle(closes)
    y = np.log(closes)
    grid = [(a, b, kalman_log_likelihood(y, np.exp(a), np.exp(b))) for a in np.linspace(-12, -6, 41) for b in np.linspace(-12, -6, 41)]
    best = max(grid, key=lambda g: g[2])
    assert ok and ll >= best[2] - 1e-6 and abs(np.log(q) - best[0]) < 0.3 and abs(np.log(r) - best[1]) < 0.3
    monkeypatch.setattr(strategies.Kalman, "run", lambda self, f, plan, own=strategies.Kalman.run: own(self, f, plan).withColumn("converged", F.col("fold") != 1))
    with pytest.warns(RuntimeWarning, match="X fold 1$"):
        walk_forward(bars(spark, oscillating(756)), Kalman(q=1e-4, r=1e-3), PLAN, resamples=20).close()
    monkeypatch.undo()
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        walk_forward(bars(spark, oscillating(756)), Kalman(q=1e-4, r=1e-3), PLAN, resamples=20).close()


def test_result_views(spark):
    with walk_forward(bars(spark, oscillating(756)), MovingAverage.fixed(20, 100), PLAN, resamples=20) as run:
        windows = run.window_results("X")
        trades = [t for w in windows for t in w.simulation_result.trade_list()]
        assert len(windows) == 2 and sum(w.metrics_result.trade_count for w in windows) == len(trades) == run.summary_metrics("X").trade_count
        assert all(isinstance(t, api.Trade) and t.exit_ts >= t.entry_ts for t in trades)
        assert windows[0].simulation_result.portfolio_values.count() == 252 and windows[0].formatted_params == "MA(20/100)"
        assert isinstance(run.benchmark_metrics("X"), api.BenchmarkResult) and isinstance(windows[0], api.WindowResult)


def test_command_lines(spark, tmp_path, capsys):
    where = {k: tmp_path / "own" / f"s.{k}" for k in ("json", "csv")}
    common = ["--demo", "--resamples", "10", "--train-years", "8", "--test-years", "8", "--output-dir", str(tmp_path)]
    assert cli.main([*common, "--strategy", "all", "--summary-json", str(where["json"]), "--summary-csv", str(where["csv"])]) == 0
    said = capsys.readouterr().out
    assert {r["strategy"] for r in json.loads(where["json"].read_text())["runs"]} == {"moving_average", "kalman", "momentum"} and len(where["csv"].read_text().splitlines()) == 4
    assert said.count("Fisher p by cost and slippage") == 3 and "slip 0.025" in said
    page = (tmp_path / "cost_sensitivity.html").read_text()
    assert page.count("<table>") == 3 and page.count("<td") == 75 and (tmp_path / "ma_SPY.html").exists()
    assert cli.main([*common, "--strategy", "momentum", "--multi", "AA", "BB", "--no-dashboard"]) == 0
    assert "Sharpe" in capsys.readouterr().out


def test_many_tickers_in_one_read(spark, tmp_path, capsys):
    raw = bars(spark, oscillating(756), symbol="A").unionByName(bars(spark, oscillating(600), symbol="B")).unionByName(bars(spark, oscillating(100), symbol="C"))
    raw.select("symbol", "ts", F.col("close").alias("adj_close"), "close", "high", "low", F.lit(1.0).alias("volume")).write.parquet(str(tmp_path / "raw"))
    code = cli.main(["--source", str(tmp_path / "raw"), "--multi", "A", "B", "C", "it's", "--strategy", "momentum", "--train-years", "1", "--test-years", "1", "--resamples", "10", "--out", str(tmp_path), "--no-dashboard"])
    said = capsys.readouterr()
    assert code == 0 and "C left out" in said.err and "it's left out: no rows" in said.err and {"A", "B"} <= {r["ticker"] for r in json.loads((tmp_path / "summary.json").read_text())["runs"]}
