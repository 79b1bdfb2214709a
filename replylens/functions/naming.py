"""Which provider serves a model id and which id a request really uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from replylens.fixed_values import BASE_MODELS, PROVIDER_PREFIXES, VERSIONED_MODELS


def registered_ids(provider: str) -> list[str]:
    served = {row[0]: row[1] for row in BASE_MODELS}
    served.update({variant: served[base] for variant, base, *_ in VERSIONED_MODELS})
    return [model for model, by in served.items() if by == provider]


def resolve_alias(model: Column) -> Column:
    """The id to call for a requested OpenAI model."""
    known = model.isin(*[m for m in registered_ids("openai") if "-" in m])
    return (
        F.when(known, model)
        .when(model.isin("gpt4", "gpt-4") | model.startswith("gpt-4-"), F.lit("gpt-4-turbo"))
        .when(model.isin("gpt4o", "gpt-4o-latest"), F.lit("gpt-4o"))
        .when(model.isin("gpt3.5", "gpt-3.5") | model.startswith("gpt-3.5-"), F.lit("gpt-3.5-turbo"))
        .otherwise(F.lit("gpt-4-turbo"))
    )


def route_provider(model: Column) -> Column:
    """Where a call is sent; everything without a known prefix goes to OpenAI."""
    return (
        F.when(model.startswith("claude-"), F.lit("anthropic"))
        .when(model.startswith("gemini-"), F.lit("google"))
        .otherwise(F.lit("openai"))
    )


def provider_by_prefix(model: Column) -> Column:
    """Provider of an unregistered id, NULL when no prefix fits."""
    fits = F.lit(None).cast("string")
    for prefix, provider in reversed(PROVIDER_PREFIXES):
        fits = F.when(model.startswith(prefix), F.lit(provider)).otherwise(fits)
    return fits
