"""Executors need not have the package: only the driver has it on its path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
def present(_):
    import importlib.util
    yield importlib.util.find_spec("basalt") is not None
assert spark.sparkContext.parallelize([1], 1).mapPartitions(present).collect() == [False]
from basalt.llm import queries
for name, query in queries.queries().items():
    print(name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_queries(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    assert len(out.stdout.split("\n")) > 10
