"""Sessions and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Own folders of applications that name none, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; an own temporary folder only where it is unset and all tasks run on this machine.

    Spark takes the setting at its start only, so an own folder is remembered here.  On a cluster a folder of one machine would be
    missed by the others, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        path = _own[app]
    return path.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: lineage ends here and lost executors lose nothing."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows; stops counting beyond."""
    return df.limit(most + 1).count() <= most


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
