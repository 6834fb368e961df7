"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(app: str = "emberline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library expects; cluster settings win.

    AQE sizes partitions from a high initial number, so one setting serves both
    a laptop and a large cluster; the time zone is fixed so dates do not move.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path for one run inside the cluster's shared checkpoint folder,
    removed when the application ends.

    On one machine, where the session may name none, the JVM's temporary folder
    stands in for it. On a cluster that would lose rows without a word, so
    there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not single_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark._jvm.java.lang.System.getProperty('java.io.tmpdir')}/emberline"
    own = f"{base.rstrip('/')}/emberline-{spark.sparkContext.applicationId}"
    if own not in _made:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(hadoop_path)
        files.deleteOnExit(hadoop_path)
        _made.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


# Folders of applications that this process has made.
_made: set[str] = set()


def single_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")
