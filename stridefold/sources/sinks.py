"""Run records as JSON and CSV, and text reports. All of these are a row a run."""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Sequence
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from stridefold import config
from stridefold.config import ExecutionConfig
from stridefold.plans.models import BENCHMARK, METRICS, Backtest


def plain(value: Any) -> Any:
    """Numbers that JSON lacks: NaN becomes null, infinities become text."""
    if isinstance(value, float) and not math.isfinite(value):
        return None if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def run_records(run: Backtest, execution: ExecutionConfig | None = None, date_range: tuple[str, str] | None = None, benchmark: bool = True) -> list[dict[str, Any]]:
    """A record a symbol. Dates come from the caller, else from the folds."""
    from pyspark.sql import functions as F

    ends = {r.symbol: r for r in run.windows.groupBy("symbol").agg(F.min("train_start").alias("a"), F.max("test_end").alias("z")).collect()}
    out = []
    for row in run.rows():
        own = ends.get(row["symbol"])
        start, end = date_range or ((str(own.a)[:10], str(own.z)[:10]) if own else (None, None))
        out.append(
            {
                "strategy": run.name,
                "ticker": row["symbol"],
                "date_range": {"start": start, "end": end} if start or end else {},
                "execution": asdict(execution) if execution else {},
                "metrics": {k: row[k] for k in (*METRICS, "window_count", "flat_cash_window_count")},
                "benchmark": {k: row[k] for k in BENCHMARK} if benchmark else None,
            }
        )
    return out


def _made(path: str | Path) -> Path:
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    return where


def write_summary_json(records: Sequence[dict[str, Any]], path: str | Path) -> Path:
    where = _made(path)
    where.write_text(json.dumps({"runs": plain(list(records))}, indent=2, allow_nan=False))
    return where


def flattened(record: dict[str, Any], head: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in record.items():
        if isinstance(v, dict):
            out |= flattened(v, f"{head}{k}.")
        else:
            out[head + k] = v
    return out


def cell(value: Any) -> Any:
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return plain(value)


def write_summary_csv(records: Sequence[dict[str, Any]], path: str | Path) -> Path:
    """Dotted columns as the first record has them; what later ones have besides is left out."""
    where, text = _made(path), io.StringIO()
    rows = [flattened(r) for r in records]
    if rows:
        writer = csv.DictWriter(text, list(rows[0]), extrasaction="ignore", restval="", lineterminator="\n")
        writer.writeheader()
        writer.writerows({k: cell(v) for k, v in r.items()} for r in rows)
    where.write_text(text.getvalue())
    return where


def shown(value: Any, spec: str = ".4f") -> str:
    """A metric as text: N/A where undefined, an infinity sign where unbounded."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "N/A"
    if isinstance(value, float) and math.isinf(value):
        return "∞" if value > 0 else "-∞"
    return format(value, spec if isinstance(value, float) else "")


def verdict_text(fisher: float, rc: float, rc_bh: float = math.nan) -> str:
    note = "" if math.isnan(rc_bh) else f" Reality Check against buy and hold: p={rc_bh:.4f}."
    if fisher < config.SIGNIFICANCE and not math.isnan(rc) and rc >= config.SIGNIFICANCE:
        return f"MARGINAL: Fisher p={fisher:.4f} is significant, the Reality Check against cash p={rc:.4f} is not.{note}"
    if fisher < config.SIGNIFICANCE:
        return f"SIGNIFICANT: Fisher p={fisher:.4f} (folds are taken as independent).{note}"
    return f"NOT SIGNIFICANT: Fisher p={fisher:.4f}."


def report(records: Sequence[dict[str, Any]]) -> str:
    """Summary, benchmark and verdict of each run, then all runs side by side; * marks the best of each metric."""
    lines: list[str] = []
    for r in records:
        m = r["metrics"]
        lines += [f"== {r['strategy']} {r['ticker']}", *(f"  {k:28}{shown(v)}" for k, v in m.items())]
        lines += [f"  {k:28}{shown(v)}" for k, v in (r["benchmark"] or {}).items()]
        lines.append("  " + verdict_text(m["combined_p_value"], m["reality_check_p_value"], m["reality_check_bh_p_value"]))
    if len(records) > 1:
        lines.append("== comparison: " + ", ".join(f"{r['strategy']} {r['ticker']}" for r in records))
        for k in METRICS:
            values = [r["metrics"][k] for r in records]
            real = [v for v in values if v is not None and math.isfinite(v)]
            best = None if not real or k == "trade_count" else min(real) if "p_value" in k else max(real)
            lines.append(f"  {k:28}" + "  ".join(shown(v) + ("*" if v == best else "") for v in values))
    return "\n".join(lines)


def cost_table(name: str, sweep: DataFrame) -> str:
    """Fisher's p of one symbol's sweep, costs down and slippages across; * where it is significant."""
    cells = {(r.cost, r.slippage): r.fisher_p for r in sweep.collect()}
    costs, slips = (sorted({k[i] for k in cells}) for i in (0, 1))
    mark = lambda p: shown(p, ".3f") + ("*" if p < config.SIGNIFICANCE else " ")
    head = f"== {name}: Fisher p by cost and slippage\n" + " " * 14 + "".join(f"{f'slip {x:.3f}':>12}" for x in slips)
    return "\n".join([head, *(f"  cost {c:.4f} " + "".join(f"{mark(cells[c, x]):>12}" for x in slips) for c in costs)])


def asset_table(table: DataFrame) -> str:
    """All runs side by side, one a line; * where Fisher's p is significant."""
    lines = [f"== {'run':20}{'Sharpe':>9}{'Fisher p':>10}{'RC cash':>9}{'RC B&H':>9}{'beats':>7}{'IR':>9}{'max DD':>9}"]
    for r in table.orderBy("run").collect():
        lines.append(
            f"   {r.run:20}{shown(r.sharpe_ratio, '.3f'):>9}{shown(r.combined_p_value) + ('*' if r.significant else ' '):>10}{shown(r.reality_check_p_value):>9}{shown(r.reality_check_bh_p_value):>9}"
            f"{shown(r.strategy_beats_benchmark_fraction, '.0%'):>7}{shown(r.information_ratio, '.3f'):>9}{shown(r.max_drawdown, '.1%'):>9}"
        )
    return "\n".join(lines)


def window_table(run: Backtest) -> str:
    """A line a fold."""
    rows = run.windows.orderBy("symbol", "fold").collect()
    return "\n".join(f"{r.symbol} {r.fold:3d} {r.test_start:%Y-%m-%d}..{r.test_end:%Y-%m-%d} {r.label:14} Sharpe {shown(r.sharpe_ratio, '.2f')} DD {shown(r.max_drawdown, '.1%')} p {shown(r.p_value, '.3f')} trades {r.trade_count}" for r in rows)
