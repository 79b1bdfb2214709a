"""Session settings and the shared folder for data that outlives a task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # texts reach Python in batches of bounded size, however long they are: a task holds several copies of one
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # limits per group are pruned in each task however many rows they keep
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    # a reply may repeat a JSON key; the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# A join side is broadcast only after it was counted under this many rows.
BROADCAST_ROWS = 100_000


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to a session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a run in one process without one gets its own."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if configured is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="replylens-"))
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Compute once and keep on shared storage, so that losing executors costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a side that is expected to be small.

    The side is computed once and counted. Within BROADCAST_ROWS it is
    broadcast and `big` is not shuffled; beyond that Spark joins by shuffle and
    AQE splits whatever key turns out to be hot. The call itself runs the jobs that
    compute and count the side.
    """
    kept = durable(small)
    return big.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, on, how)
