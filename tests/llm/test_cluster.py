"""Queries on a cluster whose workers don't have the package: master, worker and driver are processes of their own."""

import os
import re
import subprocess
import sys
import time
from contextlib import contextmanager
from pathlib import Path

import pyspark
import pytest

ROOT = Path(__file__).resolve().parents[2]
QUERIES = ("op5_suffix_dedup", "op9_phrase_dedup", "op10_jaccard_join", "op11_chosen_path", "op12_periodic_runs", "op13_prefix_trie")
#: The driver finds the package in a folder that the workers aren't told of.
DRIVER = """
import os, sys
master, root, shared, sf, *names = sys.argv[1:]
sys.path.insert(0, root)
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master(master).config("spark.checkpoint.dir", shared).config("spark.sql.shuffle.partitions", "4").config("spark.driver.host", "127.0.0.1")
    .config("spark.executor.memory", "1500m").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
import __spark_entry__, corpus_pipeline
for name in names:
    print(name, __spark_entry__.queries()[name](spark, sf).count())
stage = corpus_pipeline.STAGES[0][1]
print("pipeline", stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count())
"""


@contextmanager
def started(at: Path, says: str, *args: str, env: dict):
    """A Spark daemon, and what ``says`` finds in its log."""
    log = at / f"{args[0].rpartition('.')[2]}.log"
    with log.open("w") as out:
        daemon = subprocess.Popen(["timeout", "600", f"{Path(pyspark.__file__).parent}/bin/spark-class", *args], stdout=out, stderr=out, env=env, cwd=at)
    try:
        for _ in range(120):
            if found := re.search(says, log.read_text()):
                break
            time.sleep(0.5)
        else:
            pytest.fail(log.read_text()[-2000:])
        yield found
    finally:
        daemon.terminate()
        daemon.wait()


def test_workers_get_the_package(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED")}
    env |= {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": f"{tmp_path}/work", "SPARK_LOCAL_DIRS": f"{tmp_path}/local", "PYSPARK_PYTHON": sys.executable}
    deploy, ports = "org.apache.spark.deploy", ("--host", "127.0.0.1", "--port", "0", "--webui-port", "0")
    with (
        started(tmp_path, r"Starting Spark master at (spark://\S+)", f"{deploy}.master.Master", *ports, env=env) as master,
        started(tmp_path, "Successfully registered with master", f"{deploy}.worker.Worker", *ports, "-c", "4", "-m", "2g", master[1], env=env),
    ):
        ran = subprocess.run([sys.executable, "-c", DRIVER, master[1], str(ROOT), f"file://{tmp_path}/shared", sf, *QUERIES], capture_output=True, text=True, timeout=400, env=env, cwd=tmp_path)
    assert ran.returncode == 0, ran.stderr[-3000:]
    rows = dict(line.split() for line in ran.stdout.splitlines() if len(line.split()) == 2)
    assert set(rows) == {*QUERIES, "pipeline"} and all(int(n) > 0 for n in rows.values())
