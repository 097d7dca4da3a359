"""Rolling train and test folds by arithmetic on the bar number: equality keys, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridefold.config import FoldPlan


def counted(bars: DataFrame, plan: FoldPlan) -> DataFrame:
    """Adds ``nf``, the number of folds of the symbol."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return bars.withColumn("nf", F.greatest(F.floor((n - plan.train) / plan.test), F.lit(0)).cast("int"))


def fold_table(bars: DataFrame, plan: FoldPlan) -> DataFrame:
    """Each fold with the bar numbers and days at its ends."""
    sizes = bars.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("nf", F.floor((F.col("n") - plan.train) / plan.test).cast("int")).where("nf > 0")
    folds = sizes.select("symbol", F.explode(F.sequence(F.lit(0), F.col("nf") - 1)).alias("fold"))
    lo = F.col("fold") * plan.test
    ends = folds.select("symbol", "fold", lo.alias("train_lo"), (lo + plan.train).alias("test_lo"), (lo + plan.train + plan.test).alias("test_hi"))
    edge = ends.select("symbol", "fold", "train_lo", "test_lo", "test_hi", F.explode(F.array("train_lo", F.col("test_lo") - 1, "test_lo", F.col("test_hi") - 1)).alias("i"))
    days = edge.join(bars.select("symbol", "i", "ts"), ["symbol", "i"])
    when = lambda i: F.max(F.when(F.col("i") == i, F.col("ts")))
    return days.groupBy("symbol", "fold", "train_lo", "test_lo", "test_hi").agg(
        when(F.col("train_lo")).alias("train_start"), when(F.col("test_lo") - 1).alias("train_end"), when(F.col("test_lo")).alias("test_start"), when(F.col("test_hi") - 1).alias("test_end")
    )


def train_rows(counted_bars: DataFrame, plan: FoldPlan) -> DataFrame:
    """A row for every fold that trains on the bar: ``fold`` and ``j``, the place in its training part."""
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - plan.train + 1) / plan.test).cast("int"))
    hi = F.least(F.col("nf") - 1, F.floor(F.col("i") / plan.test).cast("int"))
    rows = counted_bars.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")  # sequence() would count downwards
    return rows.withColumn("fold", F.explode(F.sequence("lo", "hi"))).withColumn("j", F.col("i") - F.col("fold") * plan.test).drop("lo", "hi")


def test_rows(counted_bars: DataFrame, plan: FoldPlan) -> DataFrame:
    """Bars of test parts: ``fold`` and ``t``."""
    after = F.col("i") - plan.train
    rows = counted_bars.where(after >= 0).withColumn("fold", F.floor(after / plan.test).cast("int")).withColumn("t", (after % plan.test).cast("int"))
    return rows.where(F.col("fold") < F.col("nf"))


def context_rows(counted_bars: DataFrame, plan: FoldPlan, bars_before: int) -> DataFrame:
    """Test bars with up to so many bars before them; those have negative ``t``. None if 0 or less."""
    bars_before = min(max(bars_before, 0), plan.train)
    own = F.floor((F.col("i") - plan.train) / plan.test).cast("int")
    later = -(-bars_before // plan.test)  # folds after its own that a bar can be the context of
    rows = counted_bars.withColumn("fold", F.explode(F.array(*(own + k for k in range(later + 1))))).withColumn("t", F.col("i") - plan.train - F.col("fold") * plan.test)
    return rows.where((F.col("fold") >= 0) & (F.col("fold") < F.col("nf")) & (F.col("t") >= -bars_before))
