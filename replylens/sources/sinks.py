"""Writing reviews, responses and reports."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_reviews(
    reviews: DataFrame, path: str, run_id: str, at: datetime, original_file: str, selected_column: str
) -> None:
    """Keep a cleaned review set with where it came from, one partition per run.

    Writing a run again replaces that run only.
    """
    staged = reviews.select(
        "source",
        "pos",
        "review",
        F.lit(at).cast("timestamp").alias("staged_at"),
        F.lit(original_file).alias("original_file"),
        F.lit(selected_column).alias("selected_column"),
        F.lit(run_id).alias("run_id"),
    )
    writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def write_responses(responses: DataFrame, path: str) -> DataFrame:
    """Store scored responses once and return the stored table.

    Analysing the returned table instead of the run keeps a retried task from
    calling the models again. Partitioned by model, so a query about one model
    reads only its files.
    """
    responses.write.mode("overwrite").partitionBy("model").parquet(path)
    return responses.sparkSession.read.schema(responses.schema).parquet(path)


def write_report(report: DataFrame, path: str) -> str:
    """Keep report documents with their schema below `path`; a name written again has a new version. Returns the version.

    Each write has a folder of its own and is listed in the manifest once it is complete, by one file. So
    several writers do not meet, and a reader sees whole reports only.
    """
    version = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/versions/{version}"
    report.write.partitionBy("report_name").parquet(folder)
    names = report.sparkSession.read.parquet(folder).select("report_name").distinct()
    names.select(F.col("report_name").cast("string"), F.lit(version).alias("version")).coalesce(1).write.parquet(f"{path.rstrip('/')}/manifest/{version}")
    return version


def export_report(report: DataFrame, path: str) -> None:
    """Write report documents as JSON lines, for other programs to read."""
    report.write.mode("overwrite").json(path)
