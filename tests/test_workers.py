"""Python workers find the package wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from textloom.operators import splits
from textloom.session import local_session
spark = local_session(2, 2)
groups = spark.createDataFrame([(f"g{{k}}", 1 + k % 3, k % 2, 1) for k in range(40)], "group_id string, size long, human long, ai long")
print("groups", splits.assign_splits(groups).count())
"""


def test_splits_are_assigned_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "groups 40" in out.stdout, out.stderr[-2000:]
