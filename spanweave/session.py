"""Session helpers: local test sessions, lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spanweave") -> SparkSession:
    """A local session for tests and the bench (no UI, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.spanweave.inputPartitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    On a cluster a missing setting is an error, since a folder of the driver's
    own machine is of no use to the executors; ``local_session`` sets one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d and spark.sparkContext.master.startswith("local["):
        d = tempfile.mkdtemp(prefix="spanweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not d:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(d)
    return d


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


MAX_BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, cut from its lineage, with a broadcast hint if it was counted to have at most ``max_rows`` narrow rows.

    A larger one is left to an ordinary join, whose skewed partitions AQE splits.
    """
    small = checkpointed(df)
    return F.broadcast(small) if small.count() <= max_rows else small
