import subprocess
import sys

from tickerloom.session import settle, shared_dir

NAMED = """
import sys
from pathlib import Path
from tickerloom.session import local_session, settle, shared_dir
spark = local_session("1", **{"spark.checkpoint.dir": sys.argv[1]})
assert shared_dir(spark) == sys.argv[1]
assert settle(spark.range(10)).count() == 10
assert list(Path(sys.argv[1]).rglob("part-*"))
in_use = spark.sparkContext.getCheckpointDir()
settle(spark.range(3))
assert spark.sparkContext.getCheckpointDir() == in_use
print("agreed")
"""


def test_lineage_is_cut_in_the_folder_the_session_names(tmp_path):
    done = subprocess.run([sys.executable, "-c", NAMED, str(tmp_path)], capture_output=True, text=True, timeout=120)
    assert "agreed" in done.stdout, done.stderr[-2000:]


def test_a_local_session_needs_no_setting(spark):
    assert shared_dir(spark)
    assert "ExistingRDD" in settle(spark.range(3))._jdf.queryExecution().executedPlan().toString()
