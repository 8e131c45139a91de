"""Top-k search: what the driver holds, and rows that are alike."""

import os
import random
import subprocess
import sys
from collections import Counter

from basalt.llm import search
from tests.llm.test_operators import top_by_hand

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: More than 24 MB sent to the driver at once, for a result or a broadcast, is an error.
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
rows = np.random.default_rng(6).standard_normal((100000, 64)).astype(np.float32)
pq.write_table(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.FixedSizeListArray.from_arrays(rows.ravel(), 64).cast(pa.list_(pa.float32()))}), "embeddings.parquet")
spark = SparkSession.builder.master("local[4]").config("spark.driver.maxResultSize", "24m").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from basalt.llm import search
found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in search.top_k(spark.read.parquet("embeddings.parquet"), every=20).collect()}
assert len(found) == 50000, len(found)
whole = np.floor(rows.astype(np.float64) * 1024)
for q in range(0, 100000, 2000):
    scores = whole @ whole[q]
    scores[q] = -np.inf
    best = sorted(np.argsort(-scores)[:50].tolist(), key=lambda r: (-scores[r], r))[:10]
    assert [found[q, n] for n in range(1, 11)] == [(r, int(scores[r])) for r in best], q
print("as by hand")
"""


def test_search_sends_little_to_the_driver(tmp_path):
    """5000 queries of 64 dimensions: their blocks, copied for each strip of rows, were a broadcast that the driver collected."""
    out = subprocess.run([sys.executable, "-c", RUN, REPO], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert out.stdout.endswith("as by hand\n"), out.stderr[-3000:]


def test_search_among_copies(spark, monkeypatch):
    """Bounds from parts of the rows, several portions of queries, ties of other vectors, copies of queries, ids that come often with one vector or several."""
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for i in range(1, 1500)]
    rows += [(i, [2.0, 2.0, -0.0, 0.0]) for i in range(1500, 2400)] + [(i, [2.0, 2.0, 0.0, 0.0]) for i in range(2400, 2600)]
    rows += [(1600, [2.0, 2.0, 0.0, 0.0])] * 15 + [(1700, [-1.0, 2.0, 1.0, 0.0])] * 3 + [(1700, [2.0, -1.0, 0.0, 1.0])] * 3 + [(5, [2.0] * 4)] * 30 + [(300, [2.0] * 4)] * 2
    rows += [(i, [1e19 * rnd.randrange(-2, 3), 1.0, 1.0, 1.0]) for i in range(3000, 3200)]
    rnd.shuffle(rows)
    want = top_by_hand(rows, 5)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, search.top_k(vectors, 5).collect())) == want
    for name, value in {"LEAST": 100, "ENOUGH": 2, "MOST": 64, "CELLS": 640, "BROADCAST": 1000}.items():
        monkeypatch.setattr(search, name, value)
    assert Counter(map(tuple, search.top_k(vectors, 5).collect())) == want
