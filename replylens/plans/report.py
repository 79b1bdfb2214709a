"""Report tables and the report document."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.fixed_values import CHART_METRICS, NO_PROMPT, NO_RESPONSE, NO_REVIEW
from replylens.functions.text import (
    format_cost,
    format_percent,
    format_response_cost,
    format_seconds,
    iso_timestamp,
    model_label,
    report_name,
)
from replylens.operators.numbering import first_rows, number_rows
from replylens.operators.ranking import recommendations
from replylens.session import join_bounded

SAMPLES = 3
# fixed value: smallest cost a chart shows
MIN_VISIBLE_COST = 0.00001


def model_summary(stats: DataFrame, evaluation: DataFrame, texts: bool = False) -> DataFrame:
    """One row per model that ran; a missing evaluation reads as 0. Token counts are cut to integers.

    With `texts` the shares, seconds and costs are also rendered as text.
    """
    metrics = [
        "success_rate",
        "avg_latency",
        "avg_cost",
        "cost_per_1000",
        "json_validity",
        "format_consistency",
        "json_structure_consistency",
    ]
    present = [m for m in metrics if m in evaluation.columns]
    joined = stats.join(evaluation.select("model", *present), "model", "left").fillna(0.0, present)
    counts = {
        "avg_tokens": "avg_tokens",
        "avg_prompt_tokens": "avg_input_tokens",
        "avg_completion_tokens": "avg_output_tokens",
        "total_prompt_tokens": "total_input_tokens",
        "total_completion_tokens": "total_output_tokens",
        "total_tokens": "total_tokens",
    }
    table = joined.select(
        model_label(F.col("model")).alias("model_name"),
        F.col("model").alias("full_name"),
        *present,
        "total_reviews",
        F.col("successful").alias("successful_reviews"),
        F.col("errors").alias("error_count"),
        *[F.col(c).cast("bigint").alias(n) for c, n in counts.items()],
    )
    if not texts:
        return table
    shares = [c for c in ("success_rate", *metrics[4:]) if c in present]
    return table.withColumns(
        {
            **{f"{c}_text": format_percent(F.col(c)) for c in shares},
            "avg_latency_text": format_seconds(F.col("avg_latency")),
            "avg_cost_text": format_cost(F.col("avg_cost")),
            "cost_per_1000_text": format_cost(F.col("cost_per_1000"), 2),
        }
    )


def all_responses(responses: DataFrame, keys: Sequence[str] = ("model",), texts: bool = False) -> DataFrame:
    """Every response with its number within the model, in input order."""
    numbered = number_rows(responses, keys)
    table = numbered.select(
        *keys,
        "review_number",
        F.coalesce("review", F.lit(NO_REVIEW)).alias("review_text"),
        F.coalesce("prompt", F.lit(NO_PROMPT)).alias("prompt_sent"),
        F.coalesce("response", F.lit(NO_RESPONSE)).alias("response"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("total_tokens", F.lit(0)).alias("tokens"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("latency", F.lit(0.0)).alias("latency"),
    )
    if not texts:
        return table
    return table.withColumns(
        {"cost_text": format_response_cost(F.col("cost")), "latency_text": format_seconds(F.col("latency"))}
    )


def sample_response(responses: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One response per model: the first successful one, or else the first.

    The position is found over two numeric columns; the wide rows are read only
    to be matched against one position per model.
    """
    chosen = responses.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("success"), F.col("pos"))), F.min("pos")).alias("pos")
    )
    return join_bounded(responses, chosen, [*keys, "pos"])


def top_responses(responses: DataFrame, n: int = SAMPLES, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The first n responses per model, with how many more there are."""
    narrow = responses.select(*keys, "pos")
    first = first_rows(narrow, keys, n, number="review_number")
    totals = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    chosen = first.join(totals, list(keys)).select(
        *keys, "pos", F.col("review_number").cast("bigint"), F.greatest(F.col("_total") - n, F.lit(0)).alias("more")
    )
    return join_bounded(responses, chosen, [*keys, "pos"])


def chart_data(evaluation: DataFrame) -> DataFrame:
    """One row per bar: (chart, metric, model, label, value)."""
    bars = [
        F.struct(
            F.lit(chart).alias("chart"),
            F.lit(metric).alias("metric"),
            (F.greatest(F.col(metric), F.lit(MIN_VISIBLE_COST)) if chart == "cost" else F.col(metric)).alias("value"),
        )
        for chart, metric in CHART_METRICS
        if metric in evaluation.columns
    ]
    drawn = evaluation.withColumn("_bar", F.explode(F.array(*bars)))
    return drawn.select("_bar.chart", "_bar.metric", "model", model_label(F.col("model")).alias("label"), "_bar.value")


def overview(stats: DataFrame, ranking: DataFrame, source_file: str) -> DataFrame:
    """One row: the source, what ran, and the four recommendations."""
    totals = stats.agg(
        F.count(F.lit(1)).alias("models_tested"), F.coalesce(F.sum("total_reviews"), F.lit(0)).alias("total_reviews")
    )
    chosen = recommendations(ranking).drop("top_models")
    return totals.select(F.lit(source_file).alias("source_file"), "*", F.lit(1).alias("_one")).join(
        chosen.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def performance_table(summary: DataFrame) -> DataFrame:
    return summary.select("model_name", "full_name", "success_rate", "avg_latency", "cost_per_1000", "total_tokens")


def token_table(summary: DataFrame) -> DataFrame:
    return summary.select(
        "full_name", "total_input_tokens", "total_output_tokens", "avg_input_tokens", "avg_output_tokens"
    )


def report_document(
    stats: DataFrame,
    evaluation: DataFrame,
    ranking: DataFrame,
    samples: DataFrame,
    source_file: str,
    at: datetime,
    name: str | None = None,
) -> DataFrame:
    """The report as one nested row.

    It holds per-model rows only. The full responses are a table of their own
    (`all_responses`), because their number has no bound.
    """
    when = F.lit(at).cast("timestamp")
    by_metric = ranking.groupBy("metric").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "model"))), lambda r: r["model"]).alias("models")
    )
    summaries = model_summary(stats, evaluation, texts=True)
    sampled = samples.select(
        "model",
        F.struct(
            F.coalesce("review", F.lit(NO_REVIEW)).alias("review"),
            "response",
            F.col("total_tokens").alias("tokens"),
            format_response_cost(F.col("cost")).alias("cost"),
            format_seconds(F.col("latency")).alias("latency"),
        ).alias("sample"),
    )
    parts = [
        by_metric.agg(F.map_from_entries(F.collect_list(F.struct("metric", "models"))).alias("rankings")),
        summaries.agg(
            F.map_from_entries(F.collect_list(F.struct("full_name", F.struct(*summaries.columns)))).alias("models")
        ),
        recommendations(ranking).select(F.struct("*").alias("recommendations")),
        sampled.agg(F.map_from_entries(F.collect_list(F.struct("model", "sample"))).alias("sample_responses")),
        chart_data(evaluation).agg(
            F.array_sort(F.collect_list(F.struct("chart", "metric", "model", "label", "value"))).alias("charts")
        ),
    ]
    document = stats.sparkSession.range(1).select(
        F.lit(1).alias("_one"),
        (F.lit(name) if name else report_name(when)).alias("report_name"),
        iso_timestamp(when).alias("timestamp"),
        F.lit(source_file).alias("source_file"),
    )
    for part in parts:
        document = document.join(part.withColumn("_one", F.lit(1)), "_one", "left")
    return document.drop("_one")
