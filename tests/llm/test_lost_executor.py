"""Results stay whole when executors are killed in the middle of a job."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from millrace.llm import registry

pytest.importorskip("psutil")

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
CHILD = """
import json, sys, threading, time
import psutil
from pyspark.sql import SparkSession
from millrace.llm import registry

folder, name, sf = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "800m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "6", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.local.dir": f"{folder}/local"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spark.range(100).repartition(4).count()
killed = []


def executors():
    # processes may end while they are looked at
    for p in psutil.Process().children(recursive=True):
        try:
            if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()):
                yield p
        except psutil.Error:
            pass


def kill():
    while len(killed) < 2:
        time.sleep(5)
        if own := next(executors(), None):
            own.kill()
            killed.append(own.pid)


threading.Thread(target=kill, daemon=True).start()
rows = [list(r) for r in registry.queries()[name](spark, sf).collect()]
for _ in range(20):
    if killed:
        break
    rows = [list(r) for r in registry.queries()[name](spark, sf).collect()]
with open(f"{folder}/out.json", "w") as f:
    json.dump([len(killed), rows], f)
import os
os._exit(0)
"""


NAMES = ("op1_suffix_dedup", "op11_merkle_manifest", "op12_line_dedup", "op13_cross_tokenizer_alignment")


@pytest.mark.parametrize("name", NAMES)
def test_killed_executors(spark, tmp_path, name):
    (tmp_path / "work").mkdir()
    env = os.environ | {"PYTHONPATH": str(REPO), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_WORKER_DIR": str(tmp_path / "work")}
    with (tmp_path / "log").open("w") as log:
        ended = subprocess.run([sys.executable, "-c", CHILD, str(tmp_path), name, SF], env=env, cwd=tmp_path, timeout=600, stdout=log, stderr=log).returncode
    assert ended == 0, (tmp_path / "log").read_text(errors="replace")[-3000:]
    killed, rows = json.loads((tmp_path / "out.json").read_text())
    want = [list(r) for r in registry.queries()[name](spark, SF).collect()]
    assert killed >= 1 and sorted(rows) == sorted(want)
