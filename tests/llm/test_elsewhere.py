"""The functions tasks run travel with the job: workers find no ``scour`` to import."""

import os
import subprocess
import sys
import tempfile
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from scour.session import get_session
spark = get_session("local[2]", shuffle_partitions=2)
from scour.llm import queries
for q in ("op1_pii_deobfuscated", "op7_url_markov", "op10_block_nearest", "op12_conversation_repair"):
    print(q, queries.QUERIES[q](spark, "/root/testdata/sf0.001").count())
"""


def test_runs_from_a_folder_without_the_package():
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK_", "SPARK_"))}
    with tempfile.TemporaryDirectory() as folder:
        out = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    lines = [x for x in out.stdout.splitlines() if x.startswith("op")]
    assert lines == ["op1_pii_deobfuscated 200", "op7_url_markov 50", "op10_block_nearest 50", "op12_conversation_repair 20"], out.stderr[-2000:]
