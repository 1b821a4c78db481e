"""Session set-up and the two ways a fit keeps intermediate tables."""

import atexit
import gc
import shutil
import tempfile
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", shuffle_partitions=8, memory="8g", name="tabulearn"):
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tabulearn-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the table to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def configured(spark: SparkSession, settings: dict):
    """Settings of the session for the jobs started inside."""
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parts_of(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks that hold ``each`` of the amount, at least as many as the session deals out to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def written_in(df: DataFrame, parts: int) -> DataFrame:
    """``checkpointed``, with at least this many tasks behind each shuffle."""
    spark = df.sparkSession
    with configured(spark, {"spark.sql.shuffle.partitions": str(parts_of(spark, parts, 1))}):
        return checkpointed(df)


def laid_out(df: DataFrame) -> DataFrame:
    """``checkpointed``, and later joins and groups find the rows where they lie. Adaptive execution would forget that."""
    with configured(df.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
        return checkpointed(df)


def released(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles and checkpoints that nothing refers to any more; else they stay until the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept(df: DataFrame) -> DataFrame:
    """Cache for the rounds of one fit; lost blocks are rebuilt from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
