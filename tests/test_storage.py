"""Scratch tables: where they are, and that they go."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from shapespark import storage

SCRIPT = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from shapespark.storage import materialise
assert materialise(spark.range(3), "x").count() == 3
print(sum(len(f) for _, _, f in os.walk(sys.argv[1])))
spark.stop()
"""


def test_scratch_goes_with_the_application(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], capture_output=True, text=True, timeout=120, cwd=root, env={**os.environ, "PYTHONPATH": root})
    assert int(out.stdout.split()[-1]) > 0, out.stderr[-2000:]
    assert not any(f.endswith(".parquet") for _, _, files in os.walk(tmp_path) for f in files)


def test_no_local_scratch_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.scratch_dir(Session())
