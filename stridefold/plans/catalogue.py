"""Queries over the driver's tables, one for each operator of the engine.

Prices are the index bars of ``lineitem``; execution queries use the fixed
MA(50/200) rule. Results are rounded so that engines agree on every digit.
"""

from __future__ import annotations

from collections.abc import Callable

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.functions.scalars import even_chi2_tail, fisher_half, number
from stridefold.operators import benchmark as bm
from stridefold.operators import folds, metrics
from stridefold.operators.execution import execute, trades
from stridefold.operators.resample import bootstrap_p_values, candidate_matrix, hashed_draws, hashed_starts, reality_checks
from stridefold.operators.signals import bad_signals, crossings, delayed, held, returns_from_signals
from stridefold.operators.summary import MEANS, best_of, stitched_calmar, summarise, verdict
from stridefold.plans import dashboard
from stridefold.plans.strategies import Kalman, Momentum, MovingAverage
from stridefold.plans.sweep import heatmap, sweep_configs
from stridefold.plans.walk_forward import walk_forward
from stridefold.sources import bars as source

PLAN = FoldPlan()
EXECUTION = ExecutionConfig()
FIXED = MovingAverage.fixed()
KALMAN_Q, KALMAN_R = 1e-4, 1e-3
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def index(spark: SparkSession, d: str) -> DataFrame:
    return source.index_bars(items(spark, d))


def rounded(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


def fixed_signals(bars: DataFrame) -> DataFrame:
    featured = FIXED.featured(bars, PLAN)
    every = folds.test_rows(featured, PLAN).groupBy("symbol", "fold").agg(F.lit(0).alias("cand_id"))
    return FIXED.signals(featured, every, PLAN)


def executed(bars: DataFrame, configs=(EXECUTION,)) -> DataFrame:
    return execute(fixed_signals(bars), list(configs))


def fold_windows(bars: DataFrame) -> DataFrame:
    e = executed(bars)
    return metrics.calculate_metrics(e, trades(e))


@query
def bars_index(spark, d):
    return index(spark, d).select("symbol", "ts", "i", "close", "high", "low", "volume")


@query
def bars_raw_ohlc(spark, d):
    return source.raw_ohlc(items(spark, d))


@query
def bars_adjusted_clip(spark, d):
    return rounded(source.clipped(source.adjusted(source.require_columns(source.raw_ohlc(items(spark, d))))), 6, "close", "high", "low").select("symbol", "ts", "close", "high", "low", "volume")


@query
def band_gap_report(spark, d):
    off = source.index_bars(items(spark, d)).withColumn("close", F.when(F.col("i") % 50 == 7, F.col("close") * 1.01).otherwise(F.col("close")))
    return rounded(source.band_gaps(off).select("symbol", "max_gap"), 8, "max_gap")


@query
def validate_report(spark, d):
    return source.validation_report(source.supplier_symbols(items(spark, d)), 2300)


@query
def validate_skipped(spark, d):
    from stridefold.plans.multi_asset import usable

    return usable(source.supplier_symbols(items(spark, d)), FoldPlan(2200, 300))[1]


@query
def inclusive_end(spark, d):
    return source.between(index(spark, d), "1995-01-01", "1996-06-30").groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@query
def folds_plan(spark, d):
    return folds.fold_table(index(spark, d), PLAN)


@query
def fold_membership_train(spark, d):
    rows = folds.train_rows(folds.counted(index(spark, d), PLAN), PLAN)
    return rows.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum("j").alias("sum_j"))


@query
def fold_membership_test(spark, d):
    return folds.test_rows(folds.counted(index(spark, d), PLAN), PLAN).select("symbol", "i", "fold", "t")


@query
def fold_context(spark, d):
    rows = folds.context_rows(folds.counted(index(spark, d), PLAN), PLAN, 300)
    return rows.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("i").alias("first_i"))


@query
def rolling_ma(spark, d):
    rows = MovingAverage().featured(index(spark, d), PLAN)
    at = {n: i for i, n in enumerate(MovingAverage().windows())}
    return rows.where("i >= 249").select("symbol", "i", *(F.round(F.col("f")[at[n]], 9).alias(f"m{n}") for n in (20, 50, 100, 200, 250)))


@query
def ma_signals(spark, d):
    """Over the whole frame, without context: the first row is 0."""
    rows = FIXED.featured(index(spark, d), PLAN).withColumn("t", F.col("i"))
    up = (F.col("i") >= 199) & FIXED.up({"f1": 0, "f2": 1})
    return rows.withColumn("up", up).withColumn("sig", crossings(F.col("up"), ("symbol",))).where("sig <> 0").select("symbol", "i", "sig")


@query
def ma_carryover_signals(spark, d):
    return fixed_signals(index(spark, d)).where("sig <> 0 or t = 0").select("symbol", "fold", "t", "sig")


@query
def momentum_signals(spark, d):
    rule = Momentum.fixed(60)
    featured = rule.featured(index(spark, d), PLAN)
    every = folds.test_rows(featured, PLAN).groupBy("symbol", "fold").agg(F.lit(0).alias("cand_id"))
    return rule.signals(featured, every, PLAN).where("sig <> 0").select("symbol", "fold", "t", "sig")


def _best(rule, bars):
    featured = rule.featured(bars, PLAN)
    return featured, rule.fit(featured, PLAN)


@query
def momentum_candidates(spark, d):
    rule = Momentum()
    featured, fitted = _best(rule, index(spark, d))
    returns = rule.candidate_returns(featured, fitted, PLAN)
    out = returns.groupBy("symbol", "fold", "cand_id").agg(F.sum("r").alias("total"), F.count_if(F.col("r") != 0).alias("held"))
    return rounded(out, 9, "total")


@query
def ma_candidates(spark, d):
    rule = MovingAverage()
    featured, fitted = _best(rule, index(spark, d))
    out = rule.candidate_returns(featured, fitted, PLAN).groupBy("symbol", "fold", "cand_id").agg(F.sum("r").alias("total"), F.count_if(F.col("r") != 0).alias("held"))
    return rounded(out, 9, "total")


@query
def ma_grid_sharpe(spark, d):
    rule = MovingAverage()
    return rounded(rule.grid_sharpes(rule.featured(index(spark, d), PLAN), PLAN), 8, "sharpe")


@query
def ma_best_params(spark, d):
    fitted = _best(MovingAverage(), index(spark, d))[1]
    return fitted.select("symbol", "fold", F.col("params")["short_window"].cast("int").alias("short_window"), F.col("params")["long_window"].cast("int").alias("long_window"), "label", F.round("sharpe", 8).alias("sharpe"))


@query
def momentum_best_params(spark, d):
    fitted = _best(Momentum(), index(spark, d))[1]
    return fitted.select("symbol", "fold", F.col("params")["lookback"].cast("int").alias("lookback"), "label", F.round("sharpe", 8).alias("sharpe"))


@query
def signal_returns(spark, d):
    return rounded(returns_from_signals(fixed_signals(index(spark, d))).select("symbol", "fold", "t", "r"), 9, "r")


@query
def delayed_signals(spark, d):
    rows = fixed_signals(index(spark, d))
    rows = rows.select("symbol", "strategy", "fold", "t", "sig", delayed(F.col("sig"), 2).alias("late"))
    return rows.withColumn("position", held(F.col("late"))).where("late <> 0 or position").select("symbol", "fold", "t", "late", F.col("position").cast("int").alias("position"))


@query
def signal_domain(spark, d):
    rows = fixed_signals(index(spark, d)).withColumn("sig", F.when(F.col("t") % 100 == 3, 2).when(F.col("t") % 100 == 5, F.lit(None)).otherwise(F.col("sig")))
    return bad_signals(rows).groupBy("symbol", "fold").agg(F.count("*").alias("bad"))


@query
def execution_equity(spark, d):
    return rounded(executed(index(spark, d)).select("symbol", "fold", "t", "equity"), 5, "equity")


@query
def execution_baseline(spark, d):
    return rounded(executed(index(spark, d), [ExecutionConfig(config.COST_RATE, 0.0, 0)]).select("symbol", "fold", "t", "equity"), 5, "equity")


def _trades(bars):
    return trades(executed(bars))


@query
def trade_list(spark, d):
    out = _trades(index(spark, d)).select("symbol", "fold", "trade", "entry_ts", "exit_ts", "entry_price", "exit_price", "shares", "transaction_costs", "pnl")
    return rounded(out, 5, "entry_price", "exit_price", "shares", "transaction_costs", "pnl")


@query
def trade_diagnostics(spark, d):
    out = metrics.trade_metrics(_trades(index(spark, d))).select("symbol", "fold", "trade_count", "win_rate", "avg_win_loss_ratio", "avg_holding_days")
    return rounded(out, 8, "win_rate", "avg_win_loss_ratio", "avg_holding_days")


@query
def exposure(spark, d):
    return rounded(metrics.exposure(executed(index(spark, d))).select("symbol", "fold", "exposure_fraction"), 9, "exposure_fraction")


def _measure(name):
    def run(spark, d):
        e = executed(index(spark, d))
        return rounded(metrics.return_metrics(metrics.equity_returns(e)).select("symbol", "fold", name), 8, name)

    run.__name__ = name
    return query(run)


for _name in ("sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "omega_ratio"):
    _measure(_name)


@query
def window_metrics(spark, d):
    names = list(metrics.FLAT)
    return rounded(fold_windows(index(spark, d)).select("symbol", "fold", *names, "trade_count"), 8, *names)


@query
def flat_cash_windows(spark, d):
    return fold_windows(index(spark, d)).where("flat_cash").groupBy("symbol").agg(F.count("*").alias("flat_cash_window_count")).union(fold_windows(index(spark, d)).groupBy("symbol").agg(F.count("*")))


@query
def summary_means(spark, d):
    kept = [m for m in MEANS if m != "p_value"]
    e = executed(index(spark, d))
    windows = metrics.calculate_metrics(e, trades(e)).withColumn("p_value", F.lit(1.0))
    return rounded(summarise(windows, metrics.equity_returns(e)).select("symbol", *kept, "max_drawdown", "trade_count"), 8, *kept, "max_drawdown")


@query
def calmar_stitched(spark, d):
    return rounded(stitched_calmar(metrics.equity_returns(executed(index(spark, d)))).select("symbol", "calmar_ratio"), 8, "calmar_ratio")


def _fold_p(windows: DataFrame) -> DataFrame:
    """A p-value made of the fold's Sharpe ratio, for the queries that combine p-values."""
    return windows.withColumn("p", F.round(1 / (1 + F.exp(F.col("sharpe_ratio"))), 9))


@query
def fisher_p(spark, d):
    out = _fold_p(fold_windows(index(spark, d))).groupBy("symbol").agg(fisher_half(F.col("p")).alias("half"), F.count("*").alias("k"))
    return out.select("symbol", F.round(even_chi2_tail(F.col("half"), F.col("k")), 9).alias("fisher_p"))


def _candidates(bars: DataFrame) -> DataFrame:
    rule = Momentum()
    featured, fitted = _best(rule, bars)
    bh = bm.buy_and_hold_returns(folds.test_rows(featured, PLAN), EXECUTION)
    return rule.candidate_returns(featured, fitted, PLAN).join(bh.withColumnRenamed("r", "bh"), ["symbol", "fold", "t"])


@query
def candidate_matrix_means(spark, d):
    m = candidate_matrix(_candidates(index(spark, d)))
    total = lambda c: F.aggregate(c, number(0.0), lambda a, x: a + x)
    return m.select("symbol", "cand_id", "n_periods", F.round(total(F.col("r")) / F.col("n_periods"), 10).alias("mean"))


@query
def rc_common_keys(spark, d):
    part = _candidates(index(spark, d)).where(~((F.col("cand_id") == 3) & (F.col("fold") == 2)))
    return candidate_matrix(part).select("symbol", "cand_id")


def _hash_check(spark, d, null: str):
    """The Reality Check of the momentum candidates, its resamples drawn by md5 in place of the stream."""
    checked = reality_checks(candidate_matrix(_candidates(index(spark, d))), parts=4, draws=partial(hashed_draws, count=config.RESAMPLES))
    return checked.select("symbol", F.col(null).alias("p"))


@query
def rc_hash_bootstrap_cash(spark, d):
    return _hash_check(spark, d, "rc_cash")


@query
def rc_hash_bootstrap_bh(spark, d):
    return _hash_check(spark, d, "rc_bh")


@query
def block_bootstrap_hash(spark, d):
    """Each fold's Sharpe ratio against circular block resamples at hashed starts."""
    starts = lambda n: hashed_starts(n, n // int(np.sqrt(n)) + 1, config.RESAMPLES)
    windows = fold_windows(index(spark, d)).where(~F.col("flat_cash"))
    return bootstrap_p_values(windows, starts=starts).select("symbol", "fold", F.col("p_value").alias("p"))


def _test(bars):
    return folds.test_rows(folds.counted(bars, PLAN), PLAN)


@query
def bh_returns(spark, d):
    return rounded(bm.buy_and_hold_returns(_test(index(spark, d)), EXECUTION), 10, "r")


@query
def benchmark_window(spark, d):
    out = bm.benchmark_windows(bm.buy_and_hold_returns(_test(index(spark, d)), EXECUTION))
    return rounded(out, 8, "bh_sharpe", "bh_sortino", "bh_max_drawdown")


@query
def information_ratio(spark, d):
    bars = index(spark, d)
    active = bm.active_returns(metrics.equity_returns(executed(bars)), bm.buy_and_hold_returns(_test(bars), EXECUTION))
    return rounded(bm.information_ratio(active).select("symbol", "information_ratio"), 8, "information_ratio")


def _compared(spark, d):
    bars = index(spark, d)
    return bm.sharpe_comparison(fold_windows(bars), bm.benchmark_windows(bm.buy_and_hold_returns(_test(bars), EXECUTION)))


@query
def sharpe_ttest(spark, d):
    return rounded(_compared(spark, d).select("symbol", "sharpe_diff_t_stat", "sharpe_diff_p_value"), 8, "sharpe_diff_t_stat", "sharpe_diff_p_value")


@query
def beats_fraction(spark, d):
    return rounded(_compared(spark, d).select("symbol", "strategy_beats_benchmark_fraction", "benchmark_sharpe"), 8, "strategy_beats_benchmark_fraction", "benchmark_sharpe")


def _swept(bars):
    return executed(bars, sweep_configs())


@query
def cost_sweep_sharpe(spark, d):
    r = metrics.equity_returns(_swept(index(spark, d)))
    return rounded(r.groupBy("symbol", "cfg_id", "fold").agg(metrics.sharpe(F.col("r")).alias("sharpe_ratio")), 8, "sharpe_ratio")


@query
def cost_sweep_equity(spark, d):
    last = _swept(index(spark, d)).where("last")
    return rounded(last.select("symbol", "cfg_id", "fold", "cost", "slippage", "equity"), 5, "equity")


@query
def cost_heatmap_pivot(spark, d):
    last = _swept(index(spark, d)).where("last").groupBy("symbol", "strategy", "cost", "slippage").agg(F.round(F.avg("equity"), 4).alias("equity"))
    wide = heatmap(last, "equity")
    return wide.select("symbol", "cost", *(F.col(f"`slip_{s:g}`").alias("slip_" + f"{s:g}".replace(".", "_")) for s in config.SWEEP_SLIPPAGES))


@query
def multi_symbol_summary(spark, d):
    """Four symbols in one plan."""
    from stridefold.plans.multi_asset import run_multi_asset

    _, table, _ = run_multi_asset(source.supplier_symbols(items(spark, d)), {"ma": FIXED}, resamples=100)
    out = table.select("symbol", F.col("sharpe_ratio").alias("sharpe"), F.col("max_drawdown").alias("worst"), "trade_count", F.col("window_count").alias("n_folds"))
    return rounded(out, 8, "sharpe", "worst")


@query
def verdicts(spark, d):
    windows = _fold_p(fold_windows(source.supplier_symbols(items(spark, d))))
    out = windows.groupBy("symbol").agg(fisher_half(F.col("p")).alias("half"), F.count("*").alias("k"), F.max("p").alias("rc"))
    return out.select("symbol", verdict(F.round(even_chi2_tail(F.col("half"), F.col("k")), 9), F.col("rc")).alias("verdict"))


@query
def best_of_three(spark, d):
    bars, rows = index(spark, d), None
    for rule in (MovingAverage.fixed(50, 200), MovingAverage.fixed(20, 100), MovingAverage.fixed(80, 250)):
        featured = rule.featured(bars, PLAN)
        every = folds.test_rows(featured, PLAN).groupBy("symbol", "fold").agg(F.lit(0).alias("cand_id"))
        sig = rule.signals(featured, every, PLAN).withColumn("strategy", F.lit(rule.label(rule.grid()[0])))
        rows = sig if rows is None else rows.unionByName(sig)
    e = execute(rows, [EXECUTION])
    w = metrics.return_metrics(metrics.equity_returns(e)).groupBy("symbol", "strategy").agg(F.round(F.avg("sharpe_ratio"), 8).alias("sharpe"), F.round(F.min("max_drawdown"), 8).alias("drawdown"))
    return best_of(w, ("sharpe", "drawdown"), ("sharpe", "drawdown"))


@query
def equity_chained(spark, d):
    return rounded(dashboard.equity_curve(executed(index(spark, d))).select("symbol", "ts", "fold", "equity"), 5, "equity")


@query
def bh_chained(spark, d):
    return rounded(dashboard.buy_and_hold_curve(_test(index(spark, d))).select("symbol", "ts", "bh_equity"), 5, "bh_equity")


@query
def drawdown_series(spark, d):
    return rounded(dashboard.drawdowns(dashboard.equity_curve(executed(index(spark, d)))).select("symbol", "ts", "drawdown"), 8, "drawdown")


@query
def rolling_sharpe_63(spark, d):
    curve = dashboard.buy_and_hold_curve(_test(index(spark, d)))
    return rounded(dashboard.rolling_sharpe(curve, "bh_equity", ("symbol",)), 6, "rolling_sharpe")


def _bh(spark, d):
    return bm.buy_and_hold_returns(_test(index(spark, d)), EXECUTION).withColumn("r", F.round("r", 9))


@query
def return_histogram(spark, d):
    return dashboard.histogram(_bh(spark, d), ("symbol",))


@query
def return_moments(spark, d):
    return rounded(dashboard.moments(_bh(spark, d), ("symbol",)), 7, "mean", "std", "skewness", "excess_kurtosis")


@query
def normal_density(spark, d):
    r = _bh(spark, d)
    ends = r.groupBy("symbol").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    return rounded(dashboard.normal_curve(dashboard.moments(r, ("symbol",)), ends, ("symbol",)).select("symbol", "k", "x", "density"), 6, "x", "density")


@query
def fold_bar_colours(spark, d):
    bars = index(spark, d)
    both = fold_windows(bars).join(bm.benchmark_windows(bm.buy_and_hold_returns(_test(bars), EXECUTION)), ["symbol", "fold"])
    return both.select("symbol", "fold", dashboard.bar_colour(F.col("sharpe_ratio"), F.col("bh_sharpe"), number(0.0)).alias("colour"))


@query
def param_evolution(spark, d):
    return dashboard.parameter_series(_best(MovingAverage(), index(spark, d))[1]).select("symbol", "fold", "key", "value")


def _filtered(spark, d):
    """The Kalman rule with given variances: its level, signals and likelihood."""
    rule = Kalman(q=KALMAN_Q, r=KALMAN_R)
    return rule.run(rule.featured(index(spark, d), PLAN), PLAN)


@query
def kalman_filter_fixed(spark, d):
    return rounded(_filtered(spark, d).select("symbol", "fold", F.posexplode("level").alias("t", "level")), 9, "level")


@query
def kalman_signals_fixed(spark, d):
    return _filtered(spark, d).select("symbol", "fold", F.posexplode("sig").alias("t", "sig")).where("sig <> 0")


@query
def kalman_loglik_fixed(spark, d):
    return rounded(_filtered(spark, d).select("symbol", "fold", "log_likelihood"), 6, "log_likelihood")


@query
def kalman_mle(spark, d):
    rule = Kalman()
    return rule.described(rule.fit(rule.featured(index(spark, d), PLAN), PLAN)).select("symbol", "fold", "label", F.explode("params").alias("key", "value"))


@query
def block_bootstrap_pcg64(spark, d):
    return bootstrap_p_values(fold_windows(index(spark, d))).select("symbol", "fold", "p_value", "trade_count")


@query
def rc_pcg64(spark, d):
    return reality_checks(candidate_matrix(_candidates(index(spark, d))))


@query
def cost_sweep_fisher(spark, d):
    from stridefold.plans.sweep import cost_sensitivity_sweep

    return cost_sensitivity_sweep(index(spark, d), MovingAverage())


@query
def walk_forward_summary(spark, d):
    return walk_forward(index(spark, d), MovingAverage(), check=False).summary.drop("per_window_benchmark_sharpes")


@query
def walk_forward_fixed(spark, d):
    """The whole plan, its summary's columns that no random stream decides."""
    names = ("sharpe_ratio", "sortino_ratio", "omega_ratio", "max_drawdown", "calmar_ratio", "exposure_fraction", "win_rate", "avg_holding_days", "benchmark_sharpe", "information_ratio", "strategy_beats_benchmark_fraction")
    run = walk_forward(index(spark, d), FIXED, resamples=100)
    return rounded(run.summary.select("symbol", *names, "trade_count", "window_count", "flat_cash_window_count"), 8, *names)


@query
def demo_source(spark, d):
    return source.demo_bars(spark)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A row a fold: Sharpe ratio and worst drawdown of MA(50/200) on the index bars."""
    return window_metrics(spark, d).select("symbol", "fold", "sharpe_ratio", "max_drawdown", "trade_count")
