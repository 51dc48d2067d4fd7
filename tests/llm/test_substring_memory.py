"""What a Python worker takes for a strip, in a session of its own with one worker."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
RUN = r"""
import random, re, sys
from pyspark.sql import SparkSession
from lodestrand.llm import substring

spark = SparkSession.builder.config(map={"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.driver.host": "127.0.0.1"}).getOrCreate()
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(60_000)]
texts = [" ".join(rng.choices(words, k=500)) for _ in range(2_000)]

def removed(rows):
    return substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("sum(n_words)", "sum(n_removed)").first()

def status(reset):
    def run(batches):
        if reset:
            open("/proc/self/clear_refs", "w").write("5")
        kb = dict(re.findall(r"(Vm\w+):\s+(\d+) kB", open("/proc/self/status").read()))
        for b in batches:
            yield b.from_pydict({"kb": [int(kb["VmHWM"])]})
    return spark.range(1).mapInArrow(run, "kb long").first()[0]

removed([(k, t) for k, t in enumerate(texts[:5] * 2)])
before = status(True)
all_words, gone = removed([(k, t) for k, t in enumerate(texts + texts)])
print("FOUND", all_words, gone, (status(False) - before) / 1024, sum(map(len, texts)) / 2**20)
"""


@pytest.mark.skipif(not os.access("/proc/self/clear_refs", os.W_OK), reason="reads the peak where Linux keeps it")
def test_a_strip_takes_some_numbers_for_each_word():
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(REPO), os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=300)
    found = re.search(r"FOUND (\d+) (\d+) (\S+) (\S+)", out.stdout)
    assert found, out.stderr[-2000:]
    assert (int(found[1]), int(found[2])) == (2_000_000, 1_000_000)
    assert float(found[3]) < 150, f"{found[3]} MB for strips of 8 MB"
