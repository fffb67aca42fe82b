"""Shared plumbing: written intermediate tables in the cluster's shared folder, and column hygiene."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Own folders of applications that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset and all tasks run on this machine (tests) an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(_remove_local, _own[app])
        named = _own[app]
    return named.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        fs, jpath = _filesystem(spark, path)
        fs.delete(jpath, True)


class Workspace:
    """Intermediate tables of one operator run, written as Parquet so that a lost executor costs no upstream work.

    Results are read from them later, so they stay until drop() or the driver's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.workspace_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Removes tables that nothing will read again."""
        for df in saved:
            fs, path = _filesystem(self.spark, df.workspace_path)
            fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever case it is compared in."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows; stops counting beyond."""
    return df.limit(most + 1).count() <= most
