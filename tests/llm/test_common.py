"""Where intermediate tables go without spark.checkpoint.dir."""

import os
import subprocess
import sys


def test_a_session_without_the_setting_has_an_own_folder(tmp_path):
    code = "from pyspark.sql import SparkSession; from graphloom.llm.common import Workspace; s = SparkSession.builder.master('local[1]').getOrCreate(); print('rows', Workspace(s, 'x').save(s.range(3), 'y').count())"
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=180, cwd=tmp_path)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
