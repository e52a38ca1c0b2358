"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "ledgerwatch", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session. On a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder of the cluster.

    The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset, a folder
    in the session's warehouse is used, which all executors reach as well.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_ledgerwatch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts a lineage that several branches would otherwise each recompute. The table
    survives lost executors, and its known size lets Spark choose the joins. A job
    that runs again and again names a ``folder``, whose tables are replaced each time;
    otherwise every call gets a new one.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}" if folder else shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
