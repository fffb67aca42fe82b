"""Where intermediate tables go."""

import subprocess
import sys

import pytest

from graphloom import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Context:
    def __init__(self, master, app):
        self.master, self.applicationId = master, app

    def getConf(self):
        return Conf()


class Session:
    def __init__(self, master, app, **conf):
        self.sparkContext, self.conf = Context(master, app), Conf(conf)


def test_the_named_folder_or_an_own_one_on_one_machine():
    assert session.shared_folder(Session("yarn", "a", **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    one = session.shared_folder(Session("local[4]", "app-1"))
    assert one == session.shared_folder(Session("local[4]", "app-1")) != session.shared_folder(Session("local", "app-2"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Session(master, "app-3"))


def test_a_session_without_the_setting_saves(tmp_path):
    code = "from graphloom.session import local_session, save; s = local_session(1, 1); print('rows', save(s.range(3), 'x').count())"
    (tmp_path / "conf").mkdir()
    import os

    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=180, cwd=tmp_path)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
