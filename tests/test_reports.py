"""Sinks, dashboard and command line."""

import csv
import json
import math

from helpers import bars, oscillating
from stridefold import cli
from stridefold.config import ExecutionConfig, FoldPlan
from stridefold.plans.dashboard import build_dashboard
from stridefold.plans.strategies import Momentum
from stridefold.plans.walk_forward import walk_forward
from stridefold.sources.sinks import report, run_records, shown, verdict_text, window_table, write_summary_csv, write_summary_json


def test_records_to_files(spark, tmp_path):
    run = walk_forward(bars(spark, oscillating(756)), Momentum(), FoldPlan(252, 252), resamples=50)
    records = run_records(run, ExecutionConfig())
    assert records[0]["date_range"]["start"] == "2010-01-01" and records[0]["metrics"]["window_count"] == 2
    records[0]["metrics"]["omega_ratio"], records[0]["metrics"]["sortino_ratio"] = float("nan"), math.inf
    back = json.loads(write_summary_json(records, tmp_path / "a/b/s.json").read_text())["runs"][0]
    assert back["metrics"]["omega_ratio"] is None and back["metrics"]["sortino_ratio"] == "Infinity"
    rows = list(csv.DictReader(write_summary_csv(records, tmp_path / "c/s.csv").open()))
    assert rows[0]["metrics.omega_ratio"] == "" and rows[0]["metrics.sortino_ratio"] == "Infinity" and rows[0]["execution.signal_delay"] == "1"
    assert "momentum X" in report(records * 2) and "MOM(" in window_table(run)
    page = build_dashboard(run, "X", tmp_path / "d/x.html").read_text()
    assert "<svg" in page and "https://" not in page


def test_empty_and_uneven_csv(tmp_path):
    assert write_summary_csv([], tmp_path / "e.csv").read_text() == ""
    rows = list(csv.DictReader(write_summary_csv([{"a": 1, "benchmark": None}, {"a": 2, "benchmark": {"x": 1}}], tmp_path / "u.csv").open()))
    assert rows == [{"a": "1", "benchmark": ""}, {"a": "2", "benchmark": ""}]


def test_text():
    assert [shown(v) for v in (float("nan"), math.inf, -math.inf, None, 3, 0.5)] == ["N/A", "∞", "-∞", "N/A", "3", "0.5000"]
    assert verdict_text(0.01, 0.2).startswith("MARGINAL") and verdict_text(0.01, float("nan")).startswith("SIGNIFICANT") and verdict_text(0.2, 0.2).startswith("NOT")


def test_command_line(spark, tmp_path):
    code = cli.main(["--demo", "--strategy", "momentum", "--ticker", "DEMO", "--resamples", "20", "--out", str(tmp_path), "--no-dashboard"])
    assert code == 0 and json.loads((tmp_path / "summary.json").read_text())["runs"][0]["ticker"] == "DEMO"
