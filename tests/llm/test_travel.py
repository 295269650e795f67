"""Text operators on workers that do not have this package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from rankloom.session import get_spark
from rankloom.llm.queries import QUERIES
spark = get_spark("travel", "local[2]", **{{
    "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "2g", "spark.checkpoint.dir": {folder!r}}})
spark.sparkContext.setLogLevel("ERROR")

def has_package(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(id=int(importlib.util.find_spec("rankloom") is not None))

assert spark.range(1).mapInPandas(has_package, "id long").first()[0] == 0
docs = spark.read.parquet({data!r} + "/documents.parquet")
docs.limit(40).write.parquet({folder!r} + "/in/documents.parquet")
for name in ("labels", "benchmark", "embeddings", "pages"):
    spark.read.parquet({data!r} + "/" + name + ".parquet").limit(60).write.parquet({folder!r} + "/in/" + name + ".parquet")
for name in {names!r}:
    assert QUERIES[name](spark, {folder!r} + "/in").count() > 0, name
    print("travelled", name, flush=True)
"""
NAMES = [
    "op2_top_k", "op3_quality", "op4_language", "op6_suffix_dedup", "op7_byte_bpe", "op8_lattice", "op9_token_counts", "op10_simhash",
    "op11_html_extraction", "op12_periodic_runs", "op13_resampling",
]


def test_functions_and_models_travel_with_the_job(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    script = SCRIPT.format(repo=repo, folder=str(tmp_path), data="/root/testdata/sf0.001", names=NAMES)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("travelled")] == NAMES, done.stderr[-2000:]
