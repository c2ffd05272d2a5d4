"""Session settings and reliable staging of intermediate results."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions and sizes shuffles at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tamis")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, a local session takes a temporary folder and a cluster session a
    folder in the warehouse, if that is not on the driver's own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="tamis-stage-")
        if not folder:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not re.match(r"[a-z0-9]{2,}://?", warehouse) or warehouse.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = warehouse.rstrip("/") + "/_staged"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that does not exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; keeps its partitions. For narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it from there.

    Unlike a checkpoint this is columnar, so later reads prune columns.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory to the system.

    A worker, which later tasks and stages use again, would keep it, and its size would add up over stages.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)
