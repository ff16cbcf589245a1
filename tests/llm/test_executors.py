"""All operators from a driver that was started elsewhere: executors then don't have this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1200]").config("spark.executor.memory", "1200m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def lacks(_):
    try:
        import listinglab
        yield False
    except ModuleNotFoundError:
        yield True
assert spark.sparkContext.parallelize([1], 1).mapPartitions(lacks).collect() == [True]
from listinglab.llm import queries
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, {data!r}).count(), flush=True)
left = [os.path.join(d, f) for d, _, fs in os.walk({shared!r}) for f in fs if f.endswith(".parquet")]
spark.stop()
"""


def test_operators_need_no_package_on_executors(data, tmp_path):
    from listinglab.llm import queries

    names = [n for n in queries.QUERIES if n != "op9_lm_score_order2"]
    script = SCRIPT.format(root=ROOT, shared=str(tmp_path / "shared"), names=names, data=data)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME", "PYSPARK_SUBMIT_ARGS")}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env | {"SPARK_SCALA_VERSION": "2.13"}, capture_output=True, text=True, timeout=900, check=False)
    assert run.returncode == 0, run.stdout + run.stderr[-3000:]
    assert [line.split()[0] for line in run.stdout.splitlines() if line.startswith("op")] == names
