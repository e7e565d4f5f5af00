"""Functions for Python workers come with their code."""

import os
import subprocess
import sys


def test_workers_need_not_have_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from rillwater.session import local_session
from rillwater.llm import packing, personal_data, pipeline
from pyspark.sql import functions as F
spark = local_session("elsewhere", 2, 2, "1g")
docs = spark.createDataFrame([(1, "write to a.b@c.example now")], "doc_id long, text string")
print(personal_data.find(docs, [F.col("doc_id")]).first()["found"][0]["kind"],
      packing.pack(docs, pipeline.vocabulary(), F.col("doc_id")).agg(F.sum("length") > 5).first()[0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("email True"), done.stderr[-2000:]
