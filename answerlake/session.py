"""Session factory, table access and the lineage cut used by iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster leave both arguments unset: the master and the partition count
    belong to the deployment, and AQE coalesces from there.
    """
    builder = (
        SparkSession.builder.appName("answerlake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


class Tables:
    """Lazy access to the parquet tables of one directory: ``t.orders``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """The documents, spread out when they arrive as a few small files."""
        return spread(self.documents)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is made
    only for a local session that names none; on a cluster that is an error,
    because other executors could not read it back after a loss.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="answerlake-"))
    return context.getCheckpointDir()


def small_side(df: DataFrame) -> DataFrame:
    """Writes a narrow side of a join to the shared folder and reads it back.

    The plan runs once, and from the bytes of the files the optimizer sees for itself whether
    the side may be broadcast (``spark.sql.autoBroadcastJoinThreshold``); a larger one is
    shuffled, where AQE splits skewed keys.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/sides/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_BYTES_PER_CORE = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Spreads a small table (a few files that would occupy a few cores) before heavy
    per-row work. The optimizer's size estimate decides, so nothing runs; a table with
    enough splits for every core is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_BYTES_PER_CORE else df


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs re-read the rows instead of the plan."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
