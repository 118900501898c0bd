"""The local session in a process of its own, without this machine's Spark settings."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from moundflow.session import ensure_checkpoint_dir, local_session
spark = local_session(cores=2, shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = ensure_checkpoint_dir(spark)
assert folder == ensure_checkpoint_dir(spark)
spark.range(3).write.parquet(folder + "/table")
assert spark.read.parquet(folder + "/table").count() == 3
spark.range(3).checkpoint().count()
import __spark_entry__
print("rows", __spark_entry__.entry(spark).count())
"""


def test_entry_on_stock_settings(tmp_path):
    conf = tmp_path / "conf"
    conf.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    got = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    assert int(got.stdout.split("rows")[-1]) > 0
