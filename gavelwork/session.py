"""Session settings shared by tests, benchmark and command-line use."""

import os
import uuid

from pyspark.sql import SparkSession


def get_spark(app="gavelwork", cores=None, partitions=None):
    """Local session for tests and the benchmark; on a cluster the caller passes its own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def shared_base(spark):
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else a folder below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def shared_folder(spark, name):
    """A new path below the shared folder, for a table or files written between two jobs."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark):
    """The checkpoint folder in use; set to the shared folder where the session has none."""
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return spark.conf.get("spark.checkpoint.dir", None) or current or shared_base(spark)
