"""From folds to a run: means of finite values, worst drawdown, stitched Calmar, Fisher's p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefold import config
from stridefold.functions.scalars import NAN, even_chi2_tail, finite_mean, fisher_half, number
from stridefold.operators.metrics import calmar, with_drawdown

RUNS = ("symbol", "strategy", "cfg_id")
MEANS = ("sharpe_ratio", "sortino_ratio", "omega_ratio", "p_value", "exposure_fraction", "win_rate", "avg_win_loss_ratio", "avg_holding_days")


def stitched_calmar(returns: DataFrame) -> DataFrame:
    """Calmar of all folds' returns end to end; no return spans two folds."""
    return with_drawdown(returns, RUNS, ("fold", "t")).groupBy(*RUNS).agg(calmar(F.col("r"), F.min("dd")).alias("calmar_ratio"))


def summarise(windows: DataFrame, returns: DataFrame) -> DataFrame:
    sums = windows.withColumn("_p", F.col("p_value")).groupBy(*RUNS).agg(
        *(finite_mean(F.col(m)).alias(m) for m in MEANS),
        F.min("max_drawdown").alias("max_drawdown"),
        F.sum("trade_count").alias("trade_count"),
        fisher_half(F.col("_p")).alias("_half"),
        F.count("*").alias("window_count"),
        F.sum(F.col("flat_cash").cast("int")).alias("flat_cash_window_count"),
    )
    sums = sums.withColumn("combined_p_value", even_chi2_tail(F.col("_half"), F.col("window_count"))).drop("_half")
    return sums.join(stitched_calmar(returns), list(RUNS), "left").withColumn("calmar_ratio", F.coalesce("calmar_ratio", number(NAN)))


def verdict(fisher: Column, rc: Column) -> Column:
    significant = fisher < config.SIGNIFICANCE
    return F.when(significant & ~F.isnan(rc) & (rc >= config.SIGNIFICANCE), "MARGINAL").when(significant, "SIGNIFICANT").otherwise("NOT SIGNIFICANT")


def best_of(runs: DataFrame, names: tuple[str, ...], higher: tuple[str, ...]) -> DataFrame:
    """(symbol, metric, strategy): the best finite value of each metric; p-values are better low, the others high."""
    long = runs.select("symbol", "strategy", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(n in higher).alias("up")) for n in names))).alias("x")).select("symbol", "strategy", "x.*")
    long = long.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    order = F.when(F.col("up"), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("symbol", "metric").orderBy(order, "strategy")
    return long.withColumn("n", F.row_number().over(w)).where("n = 1").select("symbol", "metric", "strategy", "value")
