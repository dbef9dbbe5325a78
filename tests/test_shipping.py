"""Queries whose Python code runs in workers work in a session started anywhere, each alone in a fresh process."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as ent
from conftest import ROOT, SF_SMALL

PYTHON_QUERIES = ["h9_kde_2d", "op5_html_text"]

CODE = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.ui.enabled", "false")
         .config("spark.executor.memory", "1500m").config("spark.checkpoint.dir", "file://" + sys.argv[4])
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as ent
print("rows", ent.queries()[sys.argv[2]](spark, sys.argv[3]).count())
"""


@pytest.mark.parametrize("name", [q for q in PYTHON_QUERIES if q in ent.queries()])
def test_query_from_an_empty_folder(name, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable,
                                                                       "SPARK_SCALA_VERSION": "2.13"}
    (tmp_path / "cwd").mkdir()
    r = subprocess.run([sys.executable, "-c", CODE, ROOT, name, SF_SMALL, str(tmp_path / "shared")], cwd=tmp_path / "cwd", env=env,
                       capture_output=True, text=True, timeout=300)
    assert r.returncode == 0 and "rows" in r.stdout, r.stderr[-2000:]
