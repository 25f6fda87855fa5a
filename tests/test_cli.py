import os
import subprocess
import sys

from costlens import cli

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_list(capsys):
    assert cli.main(["list"]) == 0
    out = capsys.readouterr().out
    assert "optimal_threshold\tsql-checked" in out and "boosted_trees\trows-only" in out


def test_run_writes_and_logs(tmp_path):
    cmd = [sys.executable, "-m", "costlens.cli", "run", "confusion", "--sf", "/root/testdata/sf0.001",
           "--out", str(tmp_path / "out"), "--log", str(tmp_path / "runs"), "--cpus", "2"]
    r = subprocess.run(cmd, cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert (tmp_path / "out" / "_SUCCESS").exists()
    assert (tmp_path / "runs" / "experiment=confusion").is_dir()
