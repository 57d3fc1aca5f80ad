"""Between large steps executors and their workers give back what they hold."""

import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import json, os
import pyarrow as pa
from pyspark.sql import SparkSession
from riskloom.llm import common

spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").getOrCreate()

def told(batches):
    for batch in batches:
        had = len(common._KEPT)
        common.kept("table", lambda: [0])
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([had])], names=["pid", "had"])

def ask():
    return tuple(spark.range(1).coalesce(1).mapInArrow(told, "pid bigint, had bigint").collect()[0])

seen = [ask(), ask()]
common.release(spark)
print(json.dumps([*seen, ask()]))
"""


def test_release_empties_the_workers(tmp_path):
    root = Path(__file__).parents[2]
    for own in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors write into "work" of Spark's home
        if own.name != "work":
            (tmp_path / own.name).symlink_to(own)
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=170, cwd=root)
    first, again, after = json.loads(run.stdout.strip().split("\n")[-1])
    assert first[0] == again[0] == after[0]  # one worker
    assert (first[1], again[1], after[1]) == (0, 1, 0)
