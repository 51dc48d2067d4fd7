"""What the driver takes to fit the language field, and what the tasks of the pipeline get at once."""

import hashlib
import os
import re
import subprocess
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lodestrand.llm import substring

REPO = Path(__file__).resolve().parents[2]
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
RUN = r"""
import ctypes, random, re
from lodestrand.llm import langid

rng = random.Random(1)
letters = ["abcdefghijklmno", "hijklmnopqrstuv", "nopqrstuvwxyzäö", "uvwxyzabcdefgéè"]
words = [["".join(rng.choices(own, k=rng.randrange(4, 14))) for _ in range(11_000)] for own in letters]
rows = [(" ".join(rng.choices(words[k], k=60)), f"l{k}") for k in range(4) for _ in range(600)]

def status():
    return int(re.search(r"VmHWM:\s+(\d+) kB", open("/proc/self/status").read())[1]) / 1024

langid.fit(rows[::100], rounds=1)
ctypes.CDLL(None).malloc_trim(0)
open("/proc/self/clear_refs", "w").write("5")
before = status()
field = langid.fit(rows, rounds=2)
print("FOUND", len(field.labels), *field.weights.shape, status() - before)
"""


@pytest.mark.skipif(not os.access("/proc/self/clear_refs", os.W_OK), reason="reads the peak where Linux keeps it")
def test_the_fit_takes_some_numbers_for_each_feature():
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(REPO), os.environ.get("PYTHONPATH", "")])}
    out = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=300)
    found = re.search(r"FOUND (\d+) (\d+) (\d+) (\S+)", out.stdout)
    assert found, out.stderr[-2000:]
    assert (int(found[1]), int(found[2]), int(found[3])) == (4, 1 << 18, 4)
    assert float(found[4]) < 120, f"{found[4]} MB"


def test_stages_send_small_batches(spark, sf_dir):
    before = spark.conf.get(KEY)
    try:
        for _, stage in corpus_pipeline.STAGES[:2]:
            spark.conf.unset(KEY)
            stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20), sf_dir)
            assert int(spark.conf.get(KEY)) == corpus_pipeline.BATCH_BYTES
        rows = spark.range(400).coalesce(1).selectExpr("repeat(cast(id % 10 as string), 100000) as text")

        def sizes(batches):
            for b in batches:
                yield b.from_pydict({"bytes": [b.nbytes]})

        found = [r["bytes"] for r in rows.mapInArrow(sizes, "bytes long").collect()]
        assert sum(found) >= 40_000_000 and max(found) < 1.1 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(KEY, before)


def test_a_strip_is_a_row_group(spark, tmp_path):
    rows = [(k, " ".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(20_000))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    strips = substring._strips(docs, "doc_id", "text", [], 1, 5 << 20)
    groups = [f.metadata.row_group(k).num_rows for p in strips.inputFiles() if (f := pq.ParquetFile(p.removeprefix("file://"))) for k in range(f.num_row_groups)]
    assert len(groups) == strips.count() > 2 and set(groups) == {1}
