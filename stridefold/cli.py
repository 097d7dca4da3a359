"""Command lines: one asset with one or three strategies, or many assets."""

from __future__ import annotations

import argparse
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.plans.dashboard import build_dashboard, build_heatmap
from stridefold.plans.multi_asset import STRATEGIES, overall, run_multi_asset
from stridefold.plans.sweep import cost_sensitivity_sweep
from stridefold.plans.walk_forward import walk_forward
from stridefold.sources import bars as source
from stridefold.sources.sinks import asset_table, cost_table, report, run_records, window_table, write_summary_csv, write_summary_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stridefold", description=__doc__)
    p.add_argument("--strategy", choices=[*STRATEGIES, "all"], default="all")
    p.add_argument("--ticker", default=config.TICKER)
    p.add_argument("--multi", nargs="*", metavar="TICKER", help="many assets (default: " + " ".join(config.MULTI_TICKERS) + ")")
    p.add_argument("--source", help="Parquet or CSV of raw bars: symbol, ts, adj_close, close, high, low, volume")
    p.add_argument("--start", default=None)
    p.add_argument("--end", default=None, help="last day, included")
    p.add_argument("--train-years", type=int, default=config.TRAIN_YEARS)
    p.add_argument("--test-years", type=int, default=config.TEST_YEARS)
    p.add_argument("--cost", type=float, default=config.COST_RATE)
    p.add_argument("--slippage", type=float, default=0.05)
    p.add_argument("--delay", type=int, default=1)
    p.add_argument("--seed", type=int, default=config.SEED)
    p.add_argument("--resamples", type=int, default=config.RESAMPLES)
    p.add_argument("--costs-only", action="store_true", help="only the cost sensitivity sweep")
    p.add_argument("--demo", action="store_true", help="a synthetic path in place of a source")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--no-dashboard", action="store_true")
    p.add_argument("--cache", default="data/cache")
    p.add_argument("--output-dir", "--out", dest="out", default="results", help="folder of pages and summaries")
    p.add_argument("--summary-json", default=None, help="where the JSON summary goes (default: summary.json in the output folder)")
    p.add_argument("--summary-csv", default=None, help="where the CSV summary goes (default: summary.csv there)")
    p.add_argument("--workers", type=int, default=None, help="threads of a local session, and tasks that share a Reality Check")
    p.add_argument("--master", default=None)
    return p


def fetched(spark: SparkSession, path: str):
    return source.csv_source(spark, path) if path.endswith(".csv") else source.parquet_source(spark, path)


def loaded(spark: SparkSession, a: argparse.Namespace, ticker: str) -> DataFrame:
    if a.demo:
        return source.demo_bars(spark, a.train_years, a.test_years, a.seed, ticker)
    if not a.source:
        raise SystemExit("give --source or --demo")
    own = lambda: fetched(spark, a.source)().where(F.col("symbol") == ticker)
    return source.load_data(spark, ticker, a.start or config.START, a.end, fetch=own, cache=str(Path(a.cache).absolute()), use_cache=not a.no_cache)


def loaded_together(spark: SparkSession, a: argparse.Namespace, tickers: list[str]) -> DataFrame:
    """Bars of all tickers, read in one pass."""
    if a.demo:
        return reduce(DataFrame.unionByName, (source.demo_bars(spark, a.train_years, a.test_years, a.seed + i, t) for i, t in enumerate(tickers)))
    if not a.source:
        raise SystemExit("give --source or --demo")
    raw = source.require_columns(source.retried(lambda: fetched(spark, a.source)().where(F.col("symbol").isin(tickers))))
    bars = source.adjusted(source.between(raw, a.start or config.MULTI_START, a.end))
    off = {r.symbol: r.max_gap for r in source.band_gaps(bars).where(F.col("max_gap") > config.CLIP_TOLERANCE).collect()}  # of the tickers asked for
    for t, gap in off.items():
        print(f"{t} left out: adjusted close lies {gap:.2%} outside the day's range", file=sys.stderr)
    return source.numbered(source.clipped(bars.where(~F.col("symbol").isin(list(off))) if off else bars))


def sweeps(bars: DataFrame, names: list[str], a: argparse.Namespace, plan: FoldPlan) -> None:
    """The cost tables of the strategies, and a page of them."""
    found = {n: cost_sensitivity_sweep(bars, STRATEGIES[n](), plan, delay=a.delay, seed=a.seed, resamples=a.resamples).persist() for n in names}
    for n, sweep in found.items():
        print(cost_table(n, sweep))
    if not a.no_dashboard:
        print("cost sensitivity page:", build_heatmap(found, Path(a.out) / "cost_sensitivity.html"))
    for sweep in found.values():
        sweep.unpersist()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("stridefold").config("spark.sql.session.timeZone", "UTC")
    master = a.master or (f"local[{a.workers}]" if a.workers else None)
    spark = (builder.master(master) if master else builder).getOrCreate()
    plan, execution, out = FoldPlan.years(a.train_years, a.test_years), ExecutionConfig(a.cost, a.slippage, a.delay), Path(a.out)
    names = list(STRATEGIES) if a.strategy == "all" else [a.strategy]
    records = []
    if a.multi is not None:
        tickers = a.multi or list(config.MULTI_TICKERS)
        try:
            bars = loaded_together(spark, a, tickers)
        except (ValueError, ConnectionError) as e:
            print(e, file=sys.stderr)
            return 1
        runs, table, skipped = run_multi_asset(bars, names, plan, execution, seed=a.seed, resamples=a.resamples)
        left_out = {r.symbol: r.reason for r in skipped.collect()}
        for t in tickers:
            if t in left_out or (t not in left_out and bars.where(F.col("symbol") == t).isEmpty()):
                print(f"{t} left out: {left_out.get(t, 'no rows')}", file=sys.stderr)
        records = [x for run in runs.values() for x in run_records(run, execution)]
        print(report(records), asset_table(table), overall(table), sep="\n")
        if not a.no_dashboard:
            for n, run in runs.items():
                for x in (x["ticker"] for x in records if x["strategy"] == run.name):
                    build_dashboard(run, x, out / f"{n}_{x}.html")
        for run in runs.values():
            run.close()
    else:
        bars = source.validate_data(loaded(spark, a, a.ticker), plan.min_rows)
        for n in () if a.costs_only else names:
            with walk_forward(bars, STRATEGIES[n](), plan, execution, seed=a.seed, resamples=a.resamples, rc_parts=a.workers or 4) as run:
                print(window_table(run))
                records += run_records(run, execution)
                if not a.no_dashboard:
                    build_dashboard(run, a.ticker, out / f"{n}_{a.ticker}.html")
        if records:
            print(report(records))
    if not a.costs_only:  # before the sweep, which takes longest
        write_summary_json(records, a.summary_json or out / "summary.json")
        write_summary_csv(records, a.summary_csv or out / "summary.csv")
    if a.multi is None and (a.costs_only or a.strategy == "all"):
        sweeps(bars, names, a, plan)
    return 0 if records or a.costs_only else 1


if __name__ == "__main__":
    sys.exit(main())
