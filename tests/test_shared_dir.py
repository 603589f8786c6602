"""Where intermediates go, each case in a process of its own."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import os, sys
from pyspark.sql import SparkSession
from quillgraph.operators import graph, text
from quillgraph.session import shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
if sys.argv[1]:
    spark.sparkContext.setCheckpointDir(sys.argv[1])
docs = spark.createDataFrame([(1, "Café by the sea. Boats near the café.")], "doc_id long, text string")
assert text.vocabulary(text.with_tokens(docs)).count() > 0
edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
assert graph.pagerank(graph.vertices_of(edges), edges).count() == 3
print("FOLDER", shared_dir(spark))
"""


@pytest.mark.parametrize("named", [False, True])
def test_session_without_the_setting(tmp_path, named):
    folder = str(tmp_path / "own") if named else ""
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_SUBMIT")} | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", SCRIPT, folder], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    used = done.stdout.rpartition("FOLDER ")[2].strip()
    assert (folder in used) if named else used
