"""Session construction and the one helper that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "terrapanel", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. On a cluster pass nothing and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Tables in buckets of the entity also join on (entity, year, month) without a shuffle.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.ui.showConsoleProgress": "false",
        # Recording a Python call site per column operation makes wide plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make a local one only where none is named."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="terrapanel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(shared)


def checkpointed(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    That cuts the lineage, survives lost executors and, unlike a plain checkpoint, lets
    later passes read only the columns they need. ``release`` removes the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def scratch_path(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``checkpointed`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path is None:
            continue
        jvm = t.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
