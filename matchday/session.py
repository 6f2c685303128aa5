"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set only when the caller brings no session of its own.  Everything except the time zone is a
# performance default; the time zone is semantic (all instants are UTC).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "matchday", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on; leave resources and AQE to the deployment.

    Call-site capture is switched off too: it costs more than everything else while a plan of many
    small expressions is built, and affects only the wording of error messages.
    """
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.dataFrameQueryContext.enabled": "false"}.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder, deleted when the driver ends.

    A machine-local folder is used only where the cluster names none, which is the case in tests
    and other single-machine sessions.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/matchday-{uuid.uuid4().hex}"
        files, folder = hadoop(spark, path)
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # when the driver ends: results are read from here until then
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, path, True)
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write once to the shared area and read back: a lineage cut that survives executor loss."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
