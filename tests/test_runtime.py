"""Python workers find the package wherever the driver was started."""

from __future__ import annotations

import os
import subprocess
import sys

from tickframe import runtime

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate())
from tickframe.plans import QUERIES
print("rows", QUERIES["phase_ticks"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=ROOT, shared=str(tmp_path / "shared"))],
        cwd=tmp_path, capture_output=True, text=True, timeout=300,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows 15" in done.stdout, done.stderr[-2000:]


def test_archive_holds_the_package_and_is_stable():
    assert runtime.package_zip() == runtime.package_zip()
