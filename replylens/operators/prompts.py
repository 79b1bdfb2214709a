"""Fanning reviews out over models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.functions.text import render_prompt

PLACEHOLDER = "{review}"


def check_run(models: Sequence[str], template: str) -> None:
    """Refuse a run that cannot work, before any job starts."""
    if not models:
        raise ValueError("choose at least one model")
    if not template or not template.strip():
        raise ValueError("the prompt template is empty")
    if PLACEHOLDER not in template:
        raise ValueError(f"the prompt template has no {PLACEHOLDER} placeholder")


def fan_out(reviews: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per review and model.

    The model list is part of the request, so it becomes a constant array that
    each review row is expanded with: no join and no shuffle. A repeated id
    counts once, at its first place.
    """
    requested = [
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_ord"))
        for i, m in enumerate(dict.fromkeys(models))
    ]
    expanded = reviews.withColumn("_m", F.explode(F.array(*requested)))
    return expanded.select("_m.model", "_m.model_ord", *reviews.columns)


def render_prompts(reviews: DataFrame, models: Sequence[str], template: str) -> DataFrame:
    check_run(models, template)
    return fan_out(reviews, models).withColumn("prompt", render_prompt(template, F.col("review")))
