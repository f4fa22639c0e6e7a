"""The example scripts run end to end (small sizes)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(*args):
    return subprocess.run([sys.executable, *args], check=True, capture_output=True, text=True,
                          timeout=600, cwd=ROOT).stdout


def test_partition_report(tmp_path):
    out = _run("examples/partition_report.py", str(tmp_path), "6", "100")
    assert "n_tasks" in out and "part_ids" in out


def test_arrival_experiment():
    out = _run("examples/arrival_experiment.py", "50", "4", "0.5", "1.0")
    assert "fork-join" in out and "barrier" in out


def test_cli_index_stats(tmp_path):
    """The command line over a live log of our own job."""
    logs = tmp_path / "logs"
    logs.mkdir()
    _run(os.path.join("tests", "apps", "live_app.py"), str(logs))
    out = _run("-m", "tasklens", "index-stats", f"{logs}/eventlog_v2_*", "--rolled")
    assert "taskIndex" in out and "avg_serviceTime" in out
    _run("-m", "tasklens", "tasks", f"{logs}/eventlog_v2_*", "--rolled", "--out", str(tmp_path / "t"))
    assert any(p.suffix == ".parquet" for p in (tmp_path / "t").iterdir())


def test_queries_from_another_working_directory(tmp_path):
    """Python workers import the package even when the driver runs elsewhere."""
    app = os.path.join(ROOT, "tests", "apps", "other_cwd_app.py")
    res = subprocess.run([sys.executable, app, ROOT], check=True, capture_output=True, text=True,
                         timeout=600, cwd=str(tmp_path))
    assert "RESULT 200 200" in res.stdout
