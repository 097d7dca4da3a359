"""Price bars: where they come from, how they are cleaned and checked.

Bars are rows (symbol, ts, i, close, high, low[, volume]); ``i`` counts a
symbol's bars from 0. Everything is partitioned by symbol.
"""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridefold import config

log = logging.getLogger(__name__)
PRICES = ("close", "high", "low")


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", (F.row_number().over(by_symbol()) - 1).cast("int"))


def index_bars(lineitem: DataFrame, symbol=None) -> DataFrame:
    """Daily index bars out of unit prices: close = 100 exp(running sum of 1 % of each day's z-score), high and low 0.5 % off.

    ``symbol`` is a column expression; by default one symbol holds all rows.
    Closes are rounded to six decimals so that any engine sees the same input.
    """
    key = F.lit("IDX") if symbol is None else symbol
    days = lineitem.groupBy(key.alias("symbol"), F.col("l_shipdate").alias("ts")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("a"), F.sum("l_quantity").alias("volume"))
    whole = Window.partitionBy("symbol")
    scored = days.withColumn("z", F.coalesce(F.try_divide(F.col("a") - F.avg("a").over(whole), F.stddev_samp("a").over(whole)), F.lit(0.0)))
    running = F.sum(0.01 * F.col("z")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    closed = scored.select("symbol", "ts", F.round(100 * F.exp(running), 6).alias("close"), "volume", (F.row_number().over(by_symbol()) - 1).cast("int").alias("i"))
    return closed.select("symbol", "ts", "i", "close", F.round(F.col("close") * 1.005, 6).alias("high"), F.round(F.col("close") * 0.995, 6).alias("low"), "volume")


def supplier_symbols(lineitem: DataFrame, count: int = 4) -> DataFrame:
    return index_bars(lineitem, F.concat(F.lit("S"), (F.col("l_suppkey") % count).cast("string")))


def raw_ohlc(lineitem: DataFrame) -> DataFrame:
    """Days with their mean, highest and lowest unit price, as a vendor's raw frame with an adjusted close."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    days = lineitem.groupBy(F.col("l_shipdate").alias("ts")).agg(F.round(F.avg(unit), 6).alias("close"), F.round(F.max(unit), 6).alias("high"), F.round(F.min(unit), 6).alias("low"), F.sum("l_quantity").alias("volume"))
    return days.select(F.lit("IDX").alias("symbol"), "ts", F.round(F.col("close") * 0.99, 6).alias("adj_close"), "close", "high", "low", "volume")


def require_columns(frame: DataFrame, wanted: tuple[str, ...] = ("adj_close", "close", "high", "low")) -> DataFrame:
    """Names in snake case ("Adj Close" -> adj_close); a two-level name keeps its first level. Missing columns raise."""
    flat = [c.split("|")[0].strip("(')\" ").split("',")[0].lower().replace(" ", "_") for c in frame.columns]
    out = frame.toDF(*flat)
    if missing := sorted(set(wanted) - set(flat)):
        raise ValueError(f"missing columns: {missing}")
    return out


def adjusted(raw: DataFrame) -> DataFrame:
    """Scale high and low by adj_close / close; the adjusted close is the close."""
    factor = F.try_divide("adj_close", "close")
    rest = [c for c in raw.columns if c not in ("adj_close", *PRICES)]
    return raw.select(*rest, F.col("adj_close").alias("close"), (F.col("high") * factor).alias("high"), (F.col("low") * factor).alias("low"))


def band_gaps(bars: DataFrame) -> DataFrame:
    """Per symbol: the largest relative gap of the close outside [low, high], and the day of the largest absolute gap."""
    gap = F.greatest(F.col("low") - F.col("close"), F.col("close") - F.col("high"))
    outside = bars.where(gap > 0)
    return outside.groupBy("symbol").agg(F.max(gap / F.col("close")).alias("max_gap"), F.max_by("ts", gap).alias("worst"))


def reconciled(bars: DataFrame, tolerance: float = config.CLIP_TOLERANCE) -> DataFrame:
    """Clip closes into [low, high]; a gap above the tolerance raises."""
    bad = band_gaps(bars).where(F.col("max_gap") > tolerance).orderBy("symbol").first()
    if bad:
        raise ValueError(f"{bad.symbol}: adjusted close lies {bad.max_gap:.2%} outside the day's range on {bad.worst:%Y-%m-%d}; the tolerance is {tolerance:.1%}")
    return clipped(bars)


def clipped(bars: DataFrame) -> DataFrame:
    return bars.withColumn("close", F.greatest("low", F.least("high", "close")))


def validation_report(bars: DataFrame, min_rows: int = 0) -> DataFrame:
    """One row per symbol: rows, duplicates, nulls, nonpositive, and the first reason why it fails (null if none)."""
    close = F.col("close").cast("double")
    report = bars.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.count_distinct("ts")).alias("duplicates"),
        F.count_if(close.isNull() | F.isnan(close)).alias("nulls"),
        F.count_if(close <= 0).alias("nonpositive"),
    )
    reason = (
        F.when(F.col("duplicates") > 0, F.format_string("%d duplicate timestamps", "duplicates"))
        .when(F.col("nulls") > 0, F.format_string("%d null closes", "nulls"))
        .when(F.col("nonpositive") > 0, F.format_string("%d closes not above zero", "nonpositive"))
        .when(F.col("n_rows") < min_rows, F.format_string(f"%d rows, fewer than {min_rows}", "n_rows"))
    )
    return report.withColumn("reason", reason)


def validate_data(bars: DataFrame, min_rows: int = 0, arrival: str | None = None) -> DataFrame:
    """The bars, if every symbol passes; else ValueError with the first failure.

    ``arrival`` names a column that holds the order in which rows came, if it
    matters that they came in time order (a DataFrame has none of its own).
    """
    kinds = dict(bars.dtypes)
    if not kinds.get("ts", "").startswith(("timestamp", "date")):
        raise ValueError("ts must be a timestamp column")
    if "close" not in kinds:
        raise ValueError("no close column")
    failed = validation_report(bars, min_rows).where("reason is not null").orderBy("symbol").first()
    if failed is None and bars.isEmpty():
        raise ValueError("no rows")
    if arrival:
        back = bars.withColumn("before", F.lag("ts").over(Window.partitionBy("symbol").orderBy(arrival))).where("before > ts").limit(1)
        if not back.isEmpty():
            raise ValueError("timestamps do not increase")
    if failed:
        raise ValueError(f"{failed.symbol}: {failed.reason}")
    return bars


def between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the days from start to end, both included."""
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bars = bars.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return bars


def demo_bars(spark: SparkSession, train_years: int = config.TRAIN_YEARS, test_years: int = config.TEST_YEARS, seed: int = config.SEED, symbol: str = "DEMO") -> DataFrame:
    """A geometric Brownian path (7 % drift, 16 % volatility a year) on business days from 1993-01-04."""
    n = max(train_years + test_years + 2, 32) * config.BARS_PER_YEAR
    dt, drift, vol = 1 / config.BARS_PER_YEAR, 0.07, 0.16
    steps = np.random.default_rng(seed).normal((drift - vol * vol / 2) * dt, vol * np.sqrt(dt), n)
    close = np.maximum(100 * np.exp(np.cumsum(steps)), 1.0)
    days = np.busday_offset("1993-01-04", np.arange(n)).astype("datetime64[us]").tolist()
    rows = [(symbol, d, i, float(c), float(c * 1.005), float(c - c * 0.005)) for i, (d, c) in enumerate(zip(days, close))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, i int, close double, high double, low double")


def demo_bars_at_scale(spark: SparkSession, symbols: int, bars: int, seed: int = config.SEED) -> DataFrame:
    """The same process made by Spark, for many symbols."""
    dt, drift, vol = 1 / config.BARS_PER_YEAR, 0.07, 0.16
    rows = spark.range(symbols * bars).select(F.concat(F.lit("D"), (F.col("id") / bars).cast("long").cast("string")).alias("symbol"), (F.col("id") % bars).cast("int").alias("i"), F.randn(seed).alias("e"))
    rows = rows.withColumn("ts", F.timestamp_add("DAY", F.col("i"), F.lit("1993-01-04").cast("timestamp")).cast("timestamp_ntz"))
    path = F.sum(F.lit((drift - vol * vol / 2) * dt) + vol * dt**0.5 * F.col("e")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    closed = rows.withColumn("close", F.greatest(F.lit(1.0), 100 * F.exp(path)))
    return closed.select("symbol", "ts", "i", "close", (F.col("close") * 1.005).alias("high"), (F.col("close") * 0.995).alias("low"))


def retried(fetch: Callable[[], DataFrame], attempts: int = config.ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Call ``fetch`` until it gives rows; waits of 1, 2, ... s in between. Errors and empty answers end differently."""
    last: Exception | None = None
    for turn in range(attempts):
        try:
            frame = fetch()
            if not frame.isEmpty():
                return frame
            last = None
        except Exception as e:  # noqa: BLE001  any failure of a source is worth another try
            last = e
        if turn + 1 < attempts:
            pause(2.0**turn)
    if last is not None:
        raise ConnectionError(f"source failed {attempts} times: {last}") from last
    raise ValueError(f"source gave no rows in {attempts} attempts")


def cache_name(ticker: str, start: str, end: str | None) -> str:
    return hashlib.md5(f"{ticker.upper()}_{start}_{end or 'latest'}".encode()).hexdigest()[:12]


def load_data(
    spark: SparkSession,
    ticker: str,
    start: str = config.START,
    end: str | None = None,
    *,
    fetch: Callable[[], DataFrame],
    cache: str | None = None,
    use_cache: bool = True,
) -> DataFrame:
    """Adjusted, reconciled bars of a ticker, from the Parquet cache or by ``fetch`` (a vendor's raw frame).

    A cached answer counts for 24 hours (a year if the end is fixed); one that
    cannot be read is fetched anew, and failing to write the cache only warns.
    """
    where = f"{cache.rstrip('/')}/{cache_name(ticker, start, end)}.parquet" if cache else None
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(where) if where else None
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()) if where else None
    if where and use_cache:
        try:
            if fs.exists(jvm_path):
                age = time.time() - fs.getFileStatus(jvm_path).getModificationTime() / 1000
                if age < 3600 * (config.CACHE_HOURS_FIXED_END if end else config.CACHE_HOURS):
                    kept = spark.read.parquet(where)
                    kept.limit(1).collect()
                    return kept
        except Exception as e:  # noqa: BLE001  a broken cache is no error
            log.warning("cache of %s cannot be read: %s", ticker, e)
    raw = require_columns(retried(fetch))
    raw = raw if "symbol" in raw.columns else raw.withColumn("symbol", F.lit(ticker))
    bars = numbered(reconciled(adjusted(between(raw, start, end))))
    if where:
        try:
            bars.write.mode("overwrite").parquet(where)
        except Exception as e:  # noqa: BLE001
            log.warning("cache of %s cannot be written: %s", ticker, e)
    return bars


def csv_source(spark: SparkSession, path: str) -> Callable[[], DataFrame]:
    """A ``fetch`` that reads vendor columns from CSV, with a fixed schema."""
    schema = "symbol string, ts timestamp_ntz, adj_close double, close double, high double, low double, volume double"
    return lambda: spark.read.schema(schema).option("header", True).csv(path)


def parquet_source(spark: SparkSession, path: str) -> Callable[[], DataFrame]:
    return lambda: spark.read.parquet(path)
