"""bench.py prints one JSON line with the keys the driver reads."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_QUERIES="q_split,q_profile")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=600, cwd="/")
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and set(d["queries"]) == {"q_split", "q_profile"}
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-6


def test_bench_prints_what_it_has_when_its_limit_is_reached():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_QUERIES="q_split,q_gbt", BENCH_LIMIT_S="40")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=300, cwd="/")
    d = json.loads(out.stdout)
    assert out.returncode == 0 and "q_split" in d["queries"] and d["not_finished"] == ["q_gbt"], out.stderr[-2000:]
    assert "q_split" in out.stderr
