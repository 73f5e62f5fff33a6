"""The driver contract."""

import json
import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bench_prints_one_line(tmp_path):
    root = Path(__file__).resolve().parent.parent
    env = {"PATH": "/usr/bin:/bin:/usr/local/bin", "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_QUERIES": "upsert_latest"}
    import os

    run = subprocess.run([sys.executable, str(root / "bench.py")], env=os.environ | env, capture_output=True, text=True, timeout=200)
    assert json.loads(run.stdout.strip().splitlines()[-1])["queries"]["upsert_latest"] > 0
