"""Trade execution in closed form: long only, one position, cost-inclusive sizing.

Equity is a running product of per-trade ratios, so a window does what a
bar-by-bar loop would. Every group starts flat with INITIAL_VALUE; an open
position is sold at the last bar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefold import config
from stridefold.config import ExecutionConfig
from stridefold.operators.signals import KEYS, aligned, check_signals, delayed, held

RUN = (*KEYS, "cfg_id")


def config_column(configs: Sequence[ExecutionConfig]) -> Column:
    """The configs as a constant array to explode; a sweep has some tens of them."""
    return F.array(
        *(
            F.struct(F.lit(i).alias("cfg_id"), F.lit(float(c.transaction_cost_rate)).alias("cost"), F.lit(float(c.slippage_factor)).alias("slippage"), F.lit(int(c.signal_delay)).alias("delay"))
            for i, c in enumerate(configs)
        )
    )


def execute(rows: DataFrame, configs: Sequence[ExecutionConfig], fraction: float = config.SIZE_FRACTION, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows (keys, t, ts, close, high, low, sig) under each config.

    Signals are delayed once per distinct delay, before the configs (a handful
    of rows) multiply the bars. Adds equity, position, entry, exit, trade, fill
    prices and ``size`` (the cash a trade starts from).
    """
    if not {"high", "low"} <= set(rows.columns):
        if any(c.slippage_factor > 0 for c in configs):
            raise ValueError("slippage needs high and low")
        rows = rows.withColumns({"high": F.col("close"), "low": F.col("close")})
    by_delay = sorted({c.signal_delay for c in configs})
    rows = rows.select("*", *(delayed(F.col("sig"), d, keys).alias(f"_d{d}") for d in by_delay))
    rows = rows.select("*", *(held(F.col(f"_d{d}"), keys).alias(f"_p{d}") for d in by_delay))
    runs = rows.withColumn("_c", F.explode(config_column(configs))).select("*", "_c.*")
    position = F.coalesce(*(F.when(F.col("delay") == d, F.col(f"_p{d}")) for d in by_delay))
    keys = (*keys, "cfg_id")
    kept = [c for c in rows.columns if not c.startswith("_")]
    w = Window.partitionBy(*keys).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spread = F.coalesce(F.col("high"), F.col("close")) - F.coalesce(F.col("low"), F.col("close"))
    runs = runs.select(*kept, "cfg_id", "cost", "slippage", "delay", position.alias("position"), (F.col("close") + F.col("slippage") * spread).alias("buy"), (F.col("close") - F.col("slippage") * spread).alias("sell"))
    runs = runs.withColumns({"was": F.coalesce(F.lag("position").over(w), F.lit(False)), "last": F.lead(F.lit(1)).over(w).isNull()})
    runs = runs.withColumns({"entry": F.col("position") & ~F.col("was"), "exit": ~F.col("position") & F.col("was")})
    runs = runs.withColumns({"entry_fill": F.last(F.when(F.col("entry"), F.col("buy")), ignorenulls=True).over(upto), "trade": F.sum(F.col("entry").cast("int")).over(upto)})
    sold = 1 - fraction + fraction * F.col("sell") * (1 - F.col("cost")) / (F.col("entry_fill") * (1 + F.col("cost")))
    marked = 1 - fraction + fraction * F.col("close") / (F.col("entry_fill") * (1 + F.col("cost")))
    runs = runs.withColumn("size", config.INITIAL_VALUE * F.product(F.when(F.col("exit"), sold).otherwise(1.0)).over(upto))
    equity = F.when(F.col("position") & F.col("last"), F.col("size") * sold).when(F.col("position"), F.col("size") * marked).otherwise(F.col("size"))
    return runs.withColumn("equity", equity)


def trades(executed: DataFrame, fraction: float = config.SIZE_FRACTION, keys: Sequence[str] = RUN) -> DataFrame:
    """Completed round trips; one still open ends at the last bar."""
    closing = F.col("exit") | (F.col("position") & F.col("last"))
    legs = executed.where(F.col("position") | F.col("exit")).groupBy(*keys, "trade").agg(
        F.min(F.when(F.col("entry"), F.col("ts"))).alias("entry_ts"),
        F.max(F.when(closing, F.col("ts"))).alias("exit_ts"),
        F.min(F.when(F.col("entry"), F.col("t"))).alias("entry_t"),
        F.max(F.when(closing, F.col("t"))).alias("exit_t"),
        F.max(F.when(F.col("entry"), F.col("buy"))).alias("entry_price"),
        F.max(F.when(closing, F.col("sell"))).alias("exit_price"),
        F.max(F.when(F.col("entry"), F.col("size"))).alias("cash"),
        F.max("cost").alias("cost"),
    )
    shares = fraction * F.col("cash") / ((1 + F.col("cost")) * F.col("entry_price"))
    fees = F.col("shares") * (F.col("entry_price") + F.col("exit_price")) * F.col("cost")
    pnl = F.col("shares") * (F.col("exit_price") * (1 - F.col("cost")) - F.col("entry_price") * (1 + F.col("cost")))
    return legs.withColumn("shares", shares).select(*keys, "trade", "entry_ts", "exit_ts", "entry_t", "exit_t", "entry_price", "exit_price", "shares", fees.alias("transaction_costs"), pnl.alias("pnl"))


def run_simulation_with_execution(bars: DataFrame, signals: DataFrame, execution: ExecutionConfig | None = None, fraction: float = config.SIZE_FRACTION) -> tuple[DataFrame, DataFrame]:
    """(equity, trades) of user-made signals (symbol, ts, sig) on bars (symbol, ts, close[, high, low])."""
    rows = aligned(bars, check_signals(signals))
    rows = rows.withColumn("t", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).withColumns({"strategy": F.lit("signals"), "fold": F.lit(0)})
    executed = execute(rows, [execution or ExecutionConfig()], fraction)
    return executed, trades(executed, fraction)


def run_simulation(bars: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The baseline: the standard cost, no slippage, no delay."""
    return run_simulation_with_execution(bars, signals, ExecutionConfig(config.COST_RATE, 0.0, 0))
