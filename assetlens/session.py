"""Spark session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins and partition counts at
# runtime (broadcast only when the measured side is small, split skewed
# partitions); the session time zone is pinned so timestamps render the same
# everywhere.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "assetlens", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine's defaults.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a
    cluster both come from the submit configuration.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (it has to be on
    storage every executor can reach); an unset folder is an error there.
    Only in local mode (tests) an unset folder is replaced by a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="assetlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def drop_shared(table: DataFrame) -> None:
    """Delete the files of a ``shared_table`` that no later plan reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
