"""The library in a session somebody else built, in a process of its own: no setting of the library is given before the first query."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as driver
assert driver.entry(spark).count() == 3
from windrow.plans import load_all
first = {}
for name, entry in load_all().items():
    module = entry.plan.__module__
    if module.split(".")[-1] not in ("learning",):
        first.setdefault(module, name)
for name in first.values():
    driver.queries()[name](spark, driver.SMOKE_DIR).count()
print("plain session ran", len(first))
"""


def test_entry_and_a_query_of_every_module_run_in_a_plain_session():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "plain session ran 12" in done.stdout
