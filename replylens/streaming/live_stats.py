"""Run statistics and metrics that keep up with a run while its responses are being written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from replylens.operators.stats import finish_run_stats, run_stat_sums
from replylens.plans.evaluate import key_set_sums, metrics_of
from replylens.session import durable


def read_responses(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The response table as a stream of arriving parquet files."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(path)


def running_stats(responses: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The sums of `run_stats`; the state is one row of counters per model."""
    return responses.groupBy(*keys).agg(*run_stat_sums())


def write_stats(sums: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("model",)) -> StreamingQuery:
    """Replace the statistics table at `path` after every batch."""

    def publish(batch: DataFrame, _: int) -> None:
        finish_run_stats(batch, keys).write.mode("overwrite").parquet(path)

    return (
        sums.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def running_evaluation(
    responses: DataFrame, keys: Sequence[str] = ("model",), expected_keys: Sequence[str] | None = None, policy: str = "record"
) -> DataFrame:
    """The sums behind all metrics but the text consistency; the state is a row of counters per model and key set."""
    return key_set_sums(responses, keys, expected_keys, policy)


def write_evaluation(sums: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("model",)) -> StreamingQuery:
    """Write the metrics below `path` after every batch, as `batch=<number>`; a batch that is run again replaces its own."""

    def publish(batch: DataFrame, number: int) -> None:
        metrics_of(durable(batch), keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        sums.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def latest_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """The metrics after the last batch."""
    written = spark.read.option("basePath", path).parquet(path)
    last = written.select("batch").distinct().orderBy("batch", ascending=False).first()["batch"]
    return written.where(written["batch"] == last).drop("batch")
