"""Session helpers: a tuned local session for tests/bench, and checkpointing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "ticketlake") -> SparkSession:
    """Session for tests and the bench. On a cluster, pass nothing and let
    spark-submit decide master, resources and shuffle partitions; only a local
    master gets as many partitions as this machine has cores, and scans of few
    splits dealt over them (`spark.ticketlake.spreadScans`)."""
    builder = SparkSession.builder.appName(app)
    local = bool(master) and master.startswith("local")
    parts = shuffle_partitions or int(os.environ.get("TL_SHUFFLE_PARTITIONS", "0"))
    if local:
        parts = parts or os.cpu_count() or 8
        builder = builder.config("spark.ticketlake.spreadScans", "true").config(
            "spark.driver.memory", os.environ.get("TL_DRIVER_MEMORY", "16g"))
    if master:
        builder = builder.master(master)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by `spark.checkpoint.dir`; only a local
    session without that setting (tests, bench) gets its own scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for iterative operators")
    path = tempfile.mkdtemp(prefix="ticketlake-ckpt-", dir=os.environ.get("TL_SCRATCH", "/tmp"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)     # a scratch folder of this process alone
    sc.setCheckpointDir(path)
    return path


_WRITTEN: list[str] = []


def write_and_read(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage
    with files that outlive any executor. `options` are the writer's."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Removes the tables that `write_and_read` wrote inside the block; what the
    block returns must be written elsewhere by then."""
    start = len(_WRITTEN)
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in _WRITTEN[start:]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        del _WRITTEN[start:]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint.
    The plan is persisted for the duration of the checkpoint so the files are
    written from the computed blocks instead of a second evaluation; the
    cache is released once the checkpoint files exist."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
