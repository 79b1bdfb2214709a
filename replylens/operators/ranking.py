"""Rankings and recommendations over one evaluation row per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replylens.fixed_values import LOWER_IS_BETTER, RANKED_METRICS

# Sums of doubles depend on the order of addition in their last digits; ranks
# must not, so values are compared after rounding.
RANK_DIGITS = 12


def rank_models(
    evaluation: DataFrame, metrics: Sequence[str] = RANKED_METRICS, run: Sequence[str] = ()
) -> DataFrame:
    """Long table (metric, rank, model); ties keep the order of the models.

    A missing value ranks last on a metric where less is better, and counts as 0
    otherwise.
    """
    long = evaluation.unpivot(
        [*run, "model", "model_ord"],
        [F.col(m).cast("double").alias(m) for m in metrics],
        "metric",
        "value",
    )
    rounded = F.round("value", RANK_DIGITS)
    sort_key = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.coalesce(rounded, F.lit(float("inf")))).otherwise(
        -F.coalesce(rounded, F.lit(0.0))
    )
    order = Window.partitionBy(*run, "metric").orderBy("_key", "model_ord")
    keyed = long.withColumn("_key", sort_key + F.lit(0.0))  # -0.0 and 0.0 tie
    return keyed.withColumn("rank", F.row_number().over(order)).drop("_key")


def borda(ranking: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Overall ranking: a model earns the number of models not ranked above it, per metric."""
    field = Window.partitionBy(*run, "metric")
    points = ranking.withColumn("points", F.count(F.lit(1)).over(field) - F.col("rank") + 1)
    scores = points.groupBy(*run, "model", "model_ord").agg(F.sum("points").alias("score"))
    best = Window.partitionBy(*run).orderBy(F.col("score").desc(), "model_ord")
    return scores.withColumn("rank", F.row_number().over(best))


def full_ranking(
    evaluation: DataFrame, metrics: Sequence[str] = RANKED_METRICS, run: Sequence[str] = ()
) -> DataFrame:
    """Metric rankings and the overall one in a single long table."""
    ranking = rank_models(evaluation, metrics, run)
    overall = borda(ranking, run).select(
        *run, "model", "model_ord", F.lit("overall").alias("metric"), F.col("score").cast("double").alias("value"), "rank"
    )
    return ranking.select(*run, "model", "model_ord", "metric", "value", "rank").unionByName(overall)


def recommendations(ranking: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Best overall, up to three top models, best value, fastest and most accurate.

    One row per run; without `run` columns one row even for an empty ranking.
    """

    def first(metric: str) -> F.Column:
        return F.max(F.when((F.col("metric") == metric) & (F.col("rank") == 1), F.col("model")))

    top = F.when((F.col("metric") == "overall") & (F.col("rank") <= 3), F.struct("rank", "model"))
    chosen = ranking.filter(F.col("rank") <= 3)
    return chosen.groupBy(*run).agg(
        first("overall").alias("best_overall"),
        F.transform(F.array_sort(F.collect_list(top)), lambda t: t["model"]).alias("top_models"),
        first("avg_cost").alias("best_value"),
        first("avg_latency").alias("fastest"),
        first("json_validity").alias("most_accurate"),
    )
