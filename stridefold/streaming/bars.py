"""Daily bars from a stream of prices, to feed the batch engine.

Everything else here is batch: folds are counts of bars, not spans of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(prices: DataFrame, late: str = "1 day") -> DataFrame:
    """(symbol, ts, close, high, low, volume) a day from (symbol, at, price, size); works on streams and on tables.

    A day is final once ``late`` has passed after its end; later prices are
    dropped. The close is the price with the latest time, the higher of ties.
    State is one row per symbol and open day.
    """
    day = F.window("at", "1 day")
    last = F.max(F.struct("at", "price"))
    bars = prices.withWatermark("at", late).groupBy("symbol", day.alias("day")).agg(last.alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.col("day.start").alias("ts"), F.col("last.price").alias("close"), "high", "low", "volume")
