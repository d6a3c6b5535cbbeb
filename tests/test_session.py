"""The shared folder without any site configuration, and its cleaning, in a process of its own."""

import os
import subprocess
import sys
from pathlib import Path

from tests.conftest import DATA

CODE = """
import os
from yieldloom import session
from yieldloom.plans import registry
spark = session.local_session(cores=2, shuffle_partitions=2, memory="2g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("rows", registry.QUERIES["{query}"](spark, "{data}").count())
folder = session.shared_dir(spark)
assert os.listdir(folder) and session.clean(spark) > 0 and not os.listdir(folder)
print("rows", registry.QUERIES["{query}"](spark, "{data}").count(), folder)
"""


def run_without_configuration(code, tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-3000:]
    return [x.split() for x in out.stdout.splitlines() if x.startswith("rows")]


def test_queries_run_without_a_named_folder_and_leave_nothing(tmp_path):
    first, again = run_without_configuration(CODE.format(query="p6_found", data=DATA), tmp_path)
    assert int(first[1]) > 0 and first[1] == again[1] and not os.path.exists(again[2])


def test_kept_tables_are_made_again_when_files_change(spark, tmp_path):
    from yieldloom.session import kept
    from yieldloom.sources.tables import state_of

    made = []

    def table(n):
        made.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        if n != len(made) + 2 or not made:
            spark.range(n).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
        got = kept(spark, "n", state_of(spark, str(tmp_path), "t"), lambda n=n: table(n))
        assert got.count() == n
    assert made == [3, 4]
