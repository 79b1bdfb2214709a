"""Per-model statistics of a response log.

The aggregate lists are shared by the batch operators, the combined evaluation
and the streaming statistics. All of them are sums and counts over fixed-width
numbers: partial hash aggregation leaves one row per task and model to shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.functions.jsonx import structure_score

EVALUATION_METRICS = (
    "success_rate",
    "avg_latency",
    "avg_cost",
    "cost_per_1000",
    "avg_tokens",
    "avg_prompt_tokens",
    "avg_completion_tokens",
    "total_prompt_tokens",
    "total_completion_tokens",
    "json_validity",
    "valid_json_percentage",
    "format_consistency",
    "json_structure_consistency",
    "structural_accuracy",
)


def usable(log: DataFrame, policy: str = "record") -> Column:
    """Which rows the quality metrics count.

    `record`: the row has a response and no error field. A failed call is stored
    as a response text, so it still counts; this matches the published metrics.
    `prefix`: in addition the response must not start with `Error:`.
    """
    recorded = F.col("response").isNotNull()
    if "error" in log.columns:
        recorded = recorded & F.col("error").isNull()
    if policy == "record":
        return recorded
    if policy == "prefix":
        return recorded & ~F.col("response").startswith("Error:")
    raise ValueError(f"unknown success policy: {policy}")


def _ratio(total: Column | str, count: Column | str) -> Column:
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def _sum_where(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value).cast("double"))), F.lit(0.0))


RUN_SUMS = (
    "successful",
    "errors",
    "total_reviews",
    "total_prompt_tokens",
    "total_completion_tokens",
    "total_latency",
)


def run_stat_sums() -> list[Column]:
    """The sums named in RUN_SUMS."""
    ok = F.col("success")
    sums = (
        F.count_if(ok),
        F.count_if(~ok),
        F.count(F.lit(1)),
        _sum_where(ok, "prompt_tokens"),
        _sum_where(ok, "completion_tokens"),
        _sum_where(ok, "latency"),
    )
    return [total.alias(name) for total, name in zip(sums, RUN_SUMS, strict=True)]


def finish_run_stats(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.col("total_prompt_tokens") + F.col("total_completion_tokens")
    return sums.select(
        *keys,
        "successful",
        "errors",
        "total_reviews",
        "total_prompt_tokens",
        "total_completion_tokens",
        total.alias("total_tokens"),
        _ratio("total_prompt_tokens", "successful").alias("avg_prompt_tokens"),
        _ratio("total_completion_tokens", "successful").alias("avg_completion_tokens"),
        _ratio(total, "successful").alias("avg_tokens"),
        _ratio("total_latency", "successful").alias("average_latency"),
    )


def run_stats(log: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts, token sums and averages per model; sums are over successes only."""
    return finish_run_stats(log.groupBy(*keys).agg(*run_stat_sums()), keys)


def eval_sums(with_json: bool, expected_keys: Sequence[str] | None) -> list[Column]:
    """Partial sums behind the evaluation metrics, over rows with a `usable` flag."""
    ok = F.col("usable")
    sums = [
        F.min("model_ord").alias("model_ord"),
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(ok).alias("n"),
        _sum_where(ok, "latency").alias("latency_sum"),
        _sum_where(ok, "cost").alias("cost_sum"),
        _sum_where(ok, "prompt_tokens").alias("total_prompt_tokens"),
        _sum_where(ok, "completion_tokens").alias("total_completion_tokens"),
    ]
    if with_json:
        truthy = ok & F.col("json_truthy")
        scored = structure_score(F.col("json_keys"), expected_keys or ())
        sums += [
            F.count_if(ok & F.col("json_valid")).alias("n_valid"),
            F.count_if(truthy).alias("n_truthy"),
            F.coalesce(F.sum(F.when(truthy, scored)), F.lit(0.0)).alias("structure_sum"),
        ]
    return sums


def finish_eval(sums: DataFrame, keys: Sequence[str], with_json: bool) -> DataFrame:
    avg_cost = _ratio("cost_sum", "n")
    tokens = F.col("total_prompt_tokens") + F.col("total_completion_tokens")
    metrics = [
        _ratio("n", "n_all").alias("success_rate"),
        _ratio("latency_sum", "n").alias("avg_latency"),
        avg_cost.alias("avg_cost"),
        (avg_cost * 1000).alias("cost_per_1000"),
        _ratio(tokens, "n").alias("avg_tokens"),
        _ratio("total_prompt_tokens", "n").alias("avg_prompt_tokens"),
        _ratio("total_completion_tokens", "n").alias("avg_completion_tokens"),
        "total_prompt_tokens",
        "total_completion_tokens",
    ]
    if with_json:
        metrics += [
            _ratio("n_valid", "n").alias("json_validity"),
            (_ratio("n_truthy", "n") * 100).alias("valid_json_percentage"),
            _ratio("structure_sum", "n_truthy").alias("structural_accuracy"),
        ]
    return sums.select(*keys, "model_ord", *metrics)


def eval_basic(log: DataFrame, keys: Sequence[str] = ("model",), policy: str = "record") -> DataFrame:
    """Success, latency, cost and token metrics per model, from a log with `cost`."""
    flagged = log.withColumn("usable", usable(log, policy))
    return finish_eval(flagged.groupBy(*keys).agg(*eval_sums(False, None)), keys, False)


def with_eval_defaults(models: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row per requested model; models without a usable reply score 0 everywhere."""
    metrics = [c for c in EVALUATION_METRICS if c in evaluation.columns]
    joined = models.select("model", "model_ord").join(evaluation.drop("model_ord"), "model", "left")
    return joined.fillna(0.0, metrics)
