"""Session settings and the shared folder in which jobs cut their lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The state store that timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_own: dict[str, str] = {}


def session(app: str = "skeinworks", cores: str = "8", memory: str = "12g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(*STATE_STORE)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none, as in tests on one machine, a temporary folder is made
    and removed again when the driver ends.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {_KEY} to a folder that driver and executors share")
        _own[app] = tempfile.mkdtemp(prefix="skeinworks-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner the true size of
    the table, so that a join broadcasts it only under ``autoBroadcastJoinThreshold``. The shuffle
    files of the job go as soon as the table is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "skeinworks", f"{label}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
