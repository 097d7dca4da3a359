"""Hand-derived values, an independent simulator, and what must hold for any input."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bars, business_days, frame, oscillating, simulate
from stridefold import config
from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.functions.scalars import chi2_tail, even_chi2_tail, fisher_half, student_p, student_two_sided
from stridefold.functions.simplex import minimise
from stridefold.operators import folds, metrics
from stridefold.operators.benchmark import buy_and_hold_returns
from stridefold.operators.execution import execute, run_simulation, run_simulation_with_execution
from stridefold.operators.resample import block_bootstrap_p, build_candidate_return_matrix, stationary_draws, white_reality_check
from stridefold.operators.signals import check_signals, returns_from_signals
from stridefold.operators.summary import best_of, verdict
from stridefold.plans.multi_asset import overall, run_multi_asset
from stridefold.plans.strategies import BaseStrategy, Kalman, Momentum, MovingAverage, kalman_filter, kalman_mle
from stridefold.plans.sweep import cost_sensitivity_sweep
from stridefold.plans.walk_forward import walk_forward
from stridefold.sources import bars as source

INF = float("inf")
PLAN = FoldPlan(252, 252)


def measured(spark, returns):
    return metrics.return_metrics(metrics.equity_returns(frame(spark, returns))).first()


@pytest.mark.parametrize(
    "name, returns, value",
    [
        ("sharpe_ratio", [0.02, 0, 0.02, 0], 0.01 * math.sqrt(1_890_000)), ("sharpe_ratio", [0.01] * 4, 0.0), ("sortino_ratio", [0.05, -0.01, -0.03], 0.01 / 3 * math.sqrt(756_000)),
        ("sortino_ratio", [0.01, 0.02, 0.03], INF), ("max_drawdown", [0.1, -0.2, 0.1], -0.2), ("max_drawdown", [-0.5, 1.0], -0.5), ("calmar_ratio", [0.1, -0.2, 0.1], (0.968**84 - 1) / 0.2),
        ("omega_ratio", [0.03, 0.01, -0.01, -0.01], 2.0), ("omega_ratio", [0.01, 0.02], INF),
    ],
)
def test_metric_values(spark, name, returns, value):
    assert getattr(measured(spark, returns), name) == pytest.approx(value, abs=1e-8)


def signalled(spark, closes, sig, spread=0.0):
    b = bars(spark, closes, spread)
    s = spark.createDataFrame([("X", d, int(v)) for d, v in zip(business_days(len(closes)), sig)], "symbol string, ts timestamp_ntz, sig int")
    return b, s


def test_golden_trade(spark):
    _, t = run_simulation(*signalled(spark, range(100, 105), [0, 1, 0, -1, 0]))
    t = t.collect()
    assert len(t) == 1 and (t[0].entry_price, t[0].exit_price) == (101, 103)
    assert (t[0].shares, t[0].transaction_costs, t[0].pnl) == pytest.approx((989.109900, 201.778420, 1776.441380), abs=1e-4)


def test_forced_exit_and_idle(spark):
    e, t = run_simulation(*signalled(spark, range(100, 105), [0, 1, 0, 0, 0]))
    assert t.first().exit_price == 104 and e.where("last").first().equity == pytest.approx(102_764.562171, abs=1e-5)
    e, t = run_simulation(*signalled(spark, range(100, 105), [0] * 5))
    assert t.isEmpty() and {r.equity for r in e.collect()} == {100_000.0}


@pytest.mark.parametrize("delay, fraction", [(0, 1.0), (1, 1.0), (2, 0.5)])
def test_closed_form_equals_loop(spark, delay, fraction):
    rng = np.random.default_rng(delay)
    rows, expected = [], {}
    for g in range(25):
        n = int(rng.integers(3, 60))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        spread, sig = rng.uniform(0, 2, n), rng.choice([-1, 0, 0, 1], n)
        expected[g] = simulate(close, close + spread, close - spread, sig, 0.002, 0.1, delay, fraction)
        rows += [("X", "s", g, t, d, float(c), float(c + w), float(c - w), int(s)) for t, (d, c, w, s) in enumerate(zip(business_days(n), close, spread, sig))]
    data = spark.createDataFrame(rows, "symbol string, strategy string, fold int, t int, ts timestamp_ntz, close double, high double, low double, sig int")
    from stridefold.operators.execution import trades

    e = execute(data, [ExecutionConfig(0.002, 0.1, delay)], fraction)
    got = e.select("fold", "t", "equity").toPandas()
    done = trades(e, fraction).toPandas()
    for g, (equity, loop_trades) in expected.items():
        np.testing.assert_allclose(got[got.fold == g].sort_values("t").equity, equity, rtol=1e-11)
        own = done[done.fold == g].sort_values("entry_t")
        assert list(zip(own.entry_t, own.exit_t)) == [t[:2] for t in loop_trades]
        np.testing.assert_allclose(own.shares, [t[4] for t in loop_trades], rtol=1e-10)
        assert own.pnl.sum() == pytest.approx(equity[-1] - 100_000, abs=1e-6)


def test_hold_rule_and_domain(spark):
    rows = spark.createDataFrame([("X", "s", 0, t, 100.0 + t, s) for t, s in enumerate([0, 1, 0, 0, -1, 0])], "symbol string, strategy string, fold int, t int, close double, sig int")
    held = [r.r != 0 for r in returns_from_signals(rows).orderBy("t").collect()]
    assert held == [False, True, True, True, False]
    with pytest.raises(ValueError):
        check_signals(rows.withColumn("sig", F.lit(2)))
    with pytest.raises(ValueError):
        ExecutionConfig(-0.1)
    with pytest.raises(ValueError):
        run_simulation_with_execution(*(lambda b, s: (b.drop("high", "low"), s))(*signalled(spark, [1, 2, 3], [0, 0, 0])))


@pytest.mark.parametrize("n, count", [(504, 1), (756, 2), (503, 0)])
def test_fold_counts(spark, n, count):
    assert folds.fold_table(bars(spark, oscillating(n)), PLAN).count() == count


def test_train_folds_do_not_count_down(spark):
    rows = folds.train_rows(folds.counted(bars(spark, oscillating(800)), PLAN), PLAN)
    assert {(r.fold, r.n) for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {(0, 252), (1, 252)}


def test_bh_returns(spark):
    test = bars(spark, [100, 101, 102]).withColumns({"fold": F.lit(0), "t": F.col("i")})
    r = [x.r for x in buy_and_hold_returns(test).orderBy("t").collect()]
    assert r == pytest.approx([0.01 - 0.001, 1 / 101 - 0.001])
    two = buy_and_hold_returns(test.where("t < 2")).collect()
    assert len(two) == 1 and two[0].r == pytest.approx(0.01 - 0.002)


def test_tails(spark):
    assert chi2_tail(-2 * math.log(0.05), 2) == pytest.approx(0.05)
    q = 0.05**2
    assert chi2_tail(-4 * math.log(0.05), 4) == pytest.approx(q * (1 - math.log(q)))
    assert 0 < chi2_tail(1400.0, 56) < 1e-200
    ps = spark.createDataFrame([(0.05,), (0.05,)], "p double").agg(fisher_half(F.col("p")).alias("h"), F.count("*").alias("k"))
    assert ps.select(even_chi2_tail(F.col("h"), F.col("k")).alias("p")).first().p == pytest.approx(0.0174787, abs=1e-6)
    for df, t in ((1, 12.706), (5, 2.571), (6, 2.447), (27, 2.052)):
        assert student_two_sided(t, df) == pytest.approx(0.05, abs=1e-4)
        assert spark.range(1).select(student_p(F.lit(t), F.lit(df).cast("long")).alias("p")).first().p == pytest.approx(student_two_sided(t, df))


def test_bootstrap_equals_plain_gather():
    r = np.random.default_rng(0).normal(0.0005, 0.01, 251)
    n, size = len(r), int(np.sqrt(len(r)))
    starts = np.random.default_rng(7).integers(0, n, (300, n // size + 1))
    x = (r - r.mean())[(starts[:, :, None] + np.arange(size)).reshape(300, -1)[:, :n] % n]
    plain = np.mean(x.mean(1) / x.std(1, ddof=1) >= r.mean() / r.std(ddof=1))
    assert block_bootstrap_p(r, 7, 300) == plain


def test_reality_check_equals_plain_gather():
    m = np.random.default_rng(1).normal(0, 0.01, (120, 5))
    starts, lengths, heads = stationary_draws(120, 200, 3)
    ends = np.append(heads[1:], len(starts))
    hits = 0
    for a, z in zip(heads, ends):
        at = np.concatenate([np.arange(s, s + n) % 120 for s, n in zip(starts[a:z], lengths[a:z])])
        assert len(at) == 120
        hits += (m[at].mean(0) - m.mean(0)).max() >= m.mean(0).max()
    assert white_reality_check(m, 3, 200) == hits / 200
    assert white_reality_check(m, 3, 200, np.zeros(120)) == hits / 200
    strong = m.copy()
    strong[:, 2] += 0.01
    assert white_reality_check(strong, 3, 200) < 0.01
    for bad in (m[0], m[:, :0], m[:1]):
        with pytest.raises(ValueError):
            white_reality_check(bad)
    with pytest.raises(ValueError):
        white_reality_check(m, benchmark=np.zeros(3))


def test_candidate_matrix_of_dictionaries():
    m = build_candidate_return_matrix([{1: [1, 2], 2: [3, 4], 3: [0, 0]}, {2: [5], 1: [6]}])
    assert m.tolist() == [[1, 3], [2, 4], [6, 5]]
    for bad in ([], [{1: [0]}, {2: [0]}]):
        with pytest.raises(ValueError):
            build_candidate_return_matrix(bad)


def test_simplex_and_kalman():
    best, value, ok, _ = minimise(lambda x: float((x[0] - 3) ** 2 + 10 * (x[1] + 1) ** 2), np.array([0.0, 0.5]), 1e-8, 1e-8, 2000)
    assert ok and best == pytest.approx([3, -1], abs=1e-4) and value < 1e-7
    closes = 100 * np.exp(np.cumsum(np.random.default_rng(42).normal(0.0005, 0.01, 500)))
    q, r, ll, ok = kalman_mle(closes)
    assert ok and q / r > 1 and np.isfinite(ll)
    y, level, p, exact = np.log(closes), None, 1.0, []
    for v in y:
        level = v if level is None else level
        p += q
        k = p / (p + r)
        level, p = level + k * (v - level), (1 - k) * p
        exact.append(level)
    np.testing.assert_allclose(kalman_filter(y, q, r), exact, atol=1e-9)


def windowed(closes, plan, rule_signals):
    """Positions on the test bars of the last fold as a list, from signals made on context and test alone."""
    position, now = [], 0
    for s in rule_signals:
        now = 1 if s == 1 else 0 if s == -1 else now
        position.append(now)
    return position


def momentum_signals(close, n):
    up = np.zeros(len(close), int)
    up[n:] = np.log(close[n:]) - np.log(close[:-n]) > 0
    return np.diff(up, prepend=0)


def test_momentum_candidates_equal_windowed_truth(spark):
    """Each candidate's signals on the winner's context and the test bars, the context then cut off."""
    rng, plan, rule = np.random.default_rng(7), FoldPlan(120, 60), Momentum(lookbacks=(10, 20, 40))
    paths = {f"S{i}": 100 * np.exp(np.cumsum(rng.normal(rng.choice([-0.002, 0, 0.002]), 0.01, 180))) for i in range(12)}
    data = None
    for name, closes in paths.items():
        own = bars(spark, closes, symbol=name)
        data = own if data is None else data.unionByName(own)
    featured = rule.featured(data, plan)
    fitted = rule.fit(featured, plan).persist()
    got = rule.candidate_positions(featured, fitted, plan).toPandas()
    for r in fitted.collect():
        close, lookbacks = paths[r.symbol], rule.lookbacks
        for c, n in enumerate(lookbacks):
            sig = momentum_signals(close[120 - r.ctx :], n)[r.ctx :]
            own = got[(got.symbol == r.symbol) & (got.cand_id == c)].sort_values("t").position.astype(int).tolist()
            assert own == windowed(close, plan, sig), (r.symbol, n, r.ctx)


def test_carry_over_buys_at_the_first_bar(spark):
    data = bars(spark, 100 * np.exp(0.0015 * np.arange(1, 1201)))
    plan = FoldPlan.years(2, 1)
    run = walk_forward(data, MovingAverage(), plan, ExecutionConfig(0.001, 0, 0), resamples=50)
    assert {r.sig for r in run.signals.where("t = 0").collect()} == {1}
    assert {r.t for r in run.executed.where("entry").collect()} == {0}


def test_no_look_ahead(spark):
    closes = oscillating(756)
    changed = closes.copy()
    changed[700:] *= 1.3
    for rule in (MovingAverage(), Momentum(), Kalman()):
        a, b = (walk_forward(bars(spark, c), rule, PLAN, resamples=20).executed.where("fold = 1 and t < 190").select("t", "position").orderBy("t").collect() for c in (closes, changed))
        assert a == b


def test_grid_and_constructor_errors(spark):
    assert len(MovingAverage().grid()) == 112
    with pytest.raises(ValueError):
        MovingAverage.fixed(200, 50)
    with pytest.raises(ValueError):
        Momentum.fixed(0)
    with pytest.raises(ValueError):
        MovingAverage().candidates(100)
    with pytest.raises(ValueError):
        FoldPlan(0, 252)
    with pytest.raises(ValueError):
        walk_forward(bars(spark, oscillating(300)), MovingAverage(), PLAN)


def test_flat_folds(spark):
    data = bars(spark, np.linspace(200, 100, 520))
    run = walk_forward(data, Momentum(), PLAN, resamples=20, check=False)
    w = run.windows.first()
    assert w.flat_cash and (w.sharpe_ratio, w.max_drawdown, w.p_value, w.exposure_fraction, w.trade_count) == (0, 0, 1, 0, 0) and math.isnan(w.omega_ratio)
    assert run.candidates.where("r <> 0 or bh <> 0").isEmpty()
    s = run.rows()[0]
    assert s["flat_cash_window_count"] == 1 and s["combined_p_value"] == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        walk_forward(data, Momentum(), PLAN, resamples=20)


def test_sweep_and_multi(spark):
    data = bars(spark, oscillating(756), symbol="A").unionByName(bars(spark, oscillating(756) + 3, symbol="B")).unionByName(bars(spark, oscillating(300), symbol="C"))
    one = data.where("symbol = 'A'")
    swept = cost_sensitivity_sweep(one, Momentum(), PLAN, (0.0, 0.005), (0.0, 0.2), resamples=200).collect()
    assert len(swept) == 4
    cheap, dear = (next(r.fisher_p for r in swept if (r.cost, r.slippage) == k) for k in ((0.0, 0.0), (0.005, 0.2)))
    assert cheap <= dear
    runs, table, skipped = run_multi_asset(data, ("momentum", "kalman"), PLAN, resamples=50)
    assert {r.run for r in table.collect()} == {"A:momentum", "B:momentum", "A:kalman", "B:kalman"} and [r.symbol for r in skipped.collect()] == ["C"]
    assert all(math.isnan(r.reality_check_p_value) == (r.strategy == "kalman") for r in table.collect())
    assert "significant" in overall(table)
    with pytest.raises(ValueError):
        run_multi_asset(data, ("none",), PLAN)


def test_custom_strategy(spark):
    class Always(BaseStrategy):
        name = "always"

        def fit(self, train):
            self.level = float(train["close"].mean())
            return self

        def generate_signals(self, data):
            return pd.Series([1] + [0] * (len(data) - 1), index=data.index)

        def active_params(self):
            return {"level": self.level}

    run = walk_forward(bars(spark, oscillating(756)), Always(), PLAN, resamples=20)
    assert run.rows()[0]["trade_count"] == 2
    rows = run.windows.orderBy("fold").collect()
    assert rows[0].active_params["level"] == pytest.approx(oscillating(756)[:252].mean()) and rows[0].label.startswith("{'level'")


def test_verdict_and_best_of(spark):
    rows = spark.createDataFrame([(0.01, 0.2), (0.01, 0.01), (0.01, float("nan")), (0.2, 0.01)], "f double, rc double")
    assert [r.v for r in rows.select(verdict(F.col("f"), F.col("rc")).alias("v")).collect()] == ["MARGINAL", "SIGNIFICANT", "SIGNIFICANT", "NOT SIGNIFICANT"]
    runs = spark.createDataFrame([("X", "a", INF, 0.3), ("X", "b", 1.0, 0.1), ("X", "c", 0.5, 0.2)], "symbol string, strategy string, sharpe double, p double")
    assert {(r.metric, r.strategy) for r in best_of(runs, ("sharpe", "p"), ("sharpe",)).collect()} == {("sharpe", "b"), ("p", "b")}


def raw(spark, rows):
    return spark.createDataFrame([("X", d, *map(float, r)) for d, r in zip(business_days(len(rows)), rows)], "symbol string, ts timestamp_ntz, adj_close double, close double, high double, low double")


def test_adjust_and_reconcile(spark):
    r = source.adjusted(raw(spark, [(90, 100, 110, 88)])).first()
    assert (r.close, r.high, r.low) == pytest.approx((90, 99, 79.2))
    assert source.reconciled(source.adjusted(raw(spark, [(99, 101, 103, 101.5)]))).first().close == pytest.approx(99.490099, abs=1e-6)
    with pytest.raises(ValueError, match="range"):
        source.reconciled(source.adjusted(raw(spark, [(78, 80, 110, 100)])))
    with pytest.raises(ValueError, match="missing"):
        source.require_columns(raw(spark, [(1, 1, 1, 1)]).drop("low"))


def test_validation(spark):
    good = bars(spark, [1.0, 2.0, 3.0])
    assert source.validate_data(good) is good
    for bad in (good.unionByName(good), good.withColumn("close", F.lit(None).cast("double")), good.withColumn("close", F.lit(0.0)), good.withColumn("close", F.lit(-1.0)), good.drop("close"), good.withColumn("ts", F.col("i")), good.limit(0)):
        with pytest.raises(ValueError):
            source.validate_data(bad)
    with pytest.raises(ValueError, match="fewer"):
        source.validate_data(good, 4)
    with pytest.raises(ValueError, match="increase"):
        source.validate_data(good.withColumn("o", -F.col("i")), arrival="o")


def test_retry_and_cache(spark, tmp_path):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return raw(spark, [(1, 1, 1, 1), (2, 2, 2, 2)])

    assert source.retried(flaky, pause=waits.append).count() == 2 and waits == [1, 2]
    with pytest.raises(ValueError, match="no rows"):
        source.retried(lambda: raw(spark, [(1, 1, 1, 1)]).limit(0), pause=waits.append)
    with pytest.raises(ConnectionError):
        source.retried(lambda: 1 / 0, pause=waits.append)
    fetched = []

    def fetch():
        fetched.append(1)
        return raw(spark, [(1, 1, 1, 1), (2, 2, 2, 2)])

    for _ in range(2):
        assert source.load_data(spark, "x", fetch=fetch, cache=str(tmp_path)).count() == 2
    assert len(fetched) == 1
    source.load_data(spark, "x", fetch=fetch, cache=str(tmp_path), use_cache=False)
    assert len(fetched) == 2


def test_between_and_demo(spark):
    b = source.demo_bars(spark)
    assert b.count() == 32 * 252 and source.between(b, "1993-01-04", "1993-01-08").count() == 5
    assert source.demo_bars_at_scale(spark, 3, 50).groupBy("symbol").count().where("count = 50").count() == 3
    assert config.FoldPlan.years(3, 1).min_rows == 1008
