"""From a response log to one evaluation row per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.functions.jsonx import with_json
from replylens.functions.pricing import with_cost
from replylens.operators.pairwise import format_consistency, structure_consistency
from replylens.operators.stats import (
    EVALUATION_METRICS,
    RUN_SUMS,
    eval_sums,
    finish_eval,
    finish_run_stats,
    run_stat_sums,
    usable,
)
from replylens.session import durable

_SUMS = (
    "n_all",
    "n",
    "latency_sum",
    "cost_sum",
    "total_prompt_tokens",
    "total_completion_tokens",
    "n_valid",
    "n_truthy",
    "structure_sum",
)


def evaluate(
    log: DataFrame,
    keys: Sequence[str] = ("model",),
    expected_keys: Sequence[str] | None = None,
    policy: str = "record",
) -> DataFrame:
    """All evaluation metrics per model; see `evaluate_run`."""
    return evaluate_run(log, keys, expected_keys, policy)[0]


def key_set_sums(
    log: DataFrame, keys: Sequence[str] = ("model",), expected_keys: Sequence[str] | None = None, policy: str = "record"
) -> DataFrame:
    """Every sum behind the metrics but the text consistency, per group and key set `_set`; for batches and streams alike."""
    priced = log if "cost" in log.columns else with_cost(log)
    parsed = with_json(priced.withColumn("usable", usable(priced, policy)))
    counted = run_stat_sums() if "success" in log.columns else []
    return (
        parsed.withColumn("_set", F.when(F.col("usable"), F.col("json_keys")))
        .groupBy(*keys, "_set")
        .agg(*eval_sums(True, expected_keys), *[c.alias(f"run_{n}") for c, n in zip(counted, RUN_SUMS, strict=False)])
    )


def metrics_of(by_key_set: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The metrics that follow from the sums per key set, which are read twice."""
    group = list(keys)
    rolled = by_key_set.groupBy(*group).agg(F.min("model_ord").alias("model_ord"), *[F.sum(c).alias(c) for c in _SUMS])
    sets = by_key_set.select(*group, F.col("_set").alias("json_keys"), "n")
    metrics = finish_eval(rolled, group, True).join(structure_consistency(sets, group, replies="n"), group, "left")
    return metrics.fillna(0.0, ["json_structure_consistency"])


def evaluate_run(
    log: DataFrame,
    keys: Sequence[str] = ("model",),
    expected_keys: Sequence[str] | None = None,
    policy: str = "record",
) -> tuple[DataFrame, DataFrame | None]:
    """All evaluation metrics per model, and the run statistics if the log has `success`.

    Replies are parsed once: a first aggregate per model and key set carries
    every sum, and the metrics, the structure consistency and the statistics are
    rolled up from it. The result is stored, as rankings and reports read it again; building it
    already runs passes over the log.
    """
    group = list(keys)
    by_key_set = durable(key_set_sums(log, group, expected_keys, policy))
    texts = format_consistency(log.withColumn("usable", usable(log, policy)).filter("usable"), group)
    # one row per model on either side
    complete = metrics_of(by_key_set, group).join(texts, group, "left").fillna(0.0, ["format_consistency"])
    evaluation = durable(complete.select(*group, "model_ord", *EVALUATION_METRICS))
    if "success" not in log.columns:
        return evaluation, None
    sums = by_key_set.groupBy(*group).agg(*[F.sum(f"run_{n}").alias(n) for n in RUN_SUMS])
    return evaluation, finish_run_stats(sums, group)
