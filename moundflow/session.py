"""SparkSession helpers: a local session for tests and a checkpoint folder
that respects the cluster's ``spark.checkpoint.dir``."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "moundflow") -> SparkSession:
    """Local session used by tests and the bench (never on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.scheduler.mode", "FAIR")         # fits that run at once share the slots
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # lookups are broadcast by the size they turn out to have
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # HotSpot does not JIT-compile methods over 8000 bytecodes; past that a
        # whole-stage-codegen method runs interpreted, slower than no codegen
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` (or the folder the context already has) is used as
    it is.  Only a local session without either gets a scratch folder of its
    own; on a cluster a folder of the driver's machine would be of no use to the
    executors, so that is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # spark.checkpoint.dir is a static setting: a running session keeps the folder in its context
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="moundflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
        return sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read from there:
    compressed columns, of which later steps read those they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_slots(spark: SparkSession, per_slot: int = 4) -> int:
    """A partition count proportional to the cluster's task slots, for
    small tables that fan out (AQE would otherwise coalesce them into a few
    partitions before the expansion)."""
    try:
        slots = spark.sparkContext.defaultParallelism
    except Exception:        # no SparkContext handle: fall back to the shuffle width
        slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, slots * per_slot)
