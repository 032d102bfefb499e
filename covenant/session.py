"""Session helpers.

Cluster settings (executor sizing, ``spark.checkpoint.dir``) belong to whoever
launches the job; we only fill in what is unset so local tests run.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# SQL defaults tuned for "many executors, large shuffles". Each is applied only
# when the session has no explicit value (spark-defaults, submit options and the
# launcher's settings win).
_SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # size-checked broadcast: Spark broadcasts a join side only when its
    # (static or AQE runtime) size is under this bound, else it shuffles.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # whole-table counts of the v2 reader come from the files' footers
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_spark(master: str | None = None, app: str = "covenant",
              shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the library's SQL defaults where the session sets nothing else.

    The web UI stays off. Driver memory is chosen only for local masters (every
    task then runs inside the driver JVM); on a cluster the launcher sizes it.
    """
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("COVENANT_DRIVER_MEMORY", "12g"))
    spark = builder.getOrCreate()
    for k, v in _SQL_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only when ``spark.checkpoint.dir`` is unset and the master is local (tests)
    do we create a fresh scratch folder; on a cluster the configured shared
    path is used, and its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # executors on other machines cannot share a machine-local folder
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="covenant-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:     # each call of the setter makes a folder
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as a parquet table under the shared
    checkpoint folder and reading it back.

    Unlike an RDD checkpoint, the re-read table has file statistics (AQE and the
    broadcast check can size it) and stays a normal file scan, so Spark can
    prune its columns and reuse exchanges built on it. The files are deleted
    when the application ends: a result that reads them may live as long.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.parquet(path)
