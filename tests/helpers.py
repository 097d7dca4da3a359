"""Frames of bars and a bar-by-bar simulator to hold the closed form against."""

from __future__ import annotations

import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def business_days(n: int, start: str = "2010-01-01") -> list:
    return np.busday_offset(start, np.arange(n), roll="forward").astype("datetime64[us]").tolist()


def oscillating(n: int) -> np.ndarray:
    return 100 + 20 * np.sin(np.linspace(0, 20 * np.pi, n)) + 0.05 * np.arange(n)


def bars(spark, closes, spread: float = 0.5, symbol: str = "X", start: str = "2010-01-01"):
    rows = [(symbol, d, i, float(c), float(c + spread), float(c - spread)) for i, (d, c) in enumerate(zip(business_days(len(closes), start), closes))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, i int, close double, high double, low double")


def simulate(close, high, low, sig, cost, slip, delay, fraction=1.0):
    """(equity, trades) one bar after the other."""
    sig = ([0] * delay + list(sig))[: len(close)]
    cash, shares, entry, equity, trades = 100_000.0, 0.0, None, [], []
    for t, s in enumerate(sig):
        spread = high[t] - low[t]
        if s == 1 and not shares:
            fill = close[t] + slip * spread
            value = cash * fraction / (1 + cost)
            shares = value / fill
            cash -= value * (1 + cost)
            entry = (t, fill, value)
        elif s == -1 and shares:
            fill = close[t] - slip * spread
            cash += shares * fill * (1 - cost)
            trades.append((entry[0], t, entry[1], fill, shares))
            shares = 0.0
        equity.append(cash + shares * close[t])
    if shares:
        t = len(close) - 1
        fill = close[t] - slip * (high[t] - low[t])
        cash += shares * fill * (1 - cost)
        trades.append((entry[0], t, entry[1], fill, shares))
        equity[-1] = cash
    return equity, trades


def frame(spark, returns):
    """Equity that has the given returns, as one executed group."""
    values = 100_000 * np.cumprod([1.0, *(1 + np.asarray(returns, float))])
    pdf = pd.DataFrame({"symbol": "X", "strategy": "s", "fold": 0, "cfg_id": 0, "t": range(len(values)), "ts": pd.to_datetime(business_days(len(values))), "equity": values})
    return spark.createDataFrame(pdf)
