"""Price lookup and cost of a call.

The price list is configuration with a fixed size, so the lookup is an
expression over a constant array: no join, no shuffle, and it works unchanged on
a stream.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.fixed_values import DEFAULT_PRICE_KEY, PRICES

_ENTRY = (
    "struct<key: string, input: double, output: double, tier_threshold: bigint, "
    "tier2_input: double, tier2_output: double, price_source: string>"
)
_NAMES = ("key", "input", "output", "tier_threshold", "tier2_input", "tier2_output", "price_source")


def _entry(row: Sequence, source: str) -> dict:
    return dict(zip(_NAMES, (*row, source)))


def _constant(value: object, kind: str) -> Column:
    """A nested constant: one small expression that Spark folds before it runs."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def price_of(model: Column, prices: Sequence[Sequence] = PRICES) -> Column:
    """The price row for a model id, with how it was found in `price_source`.

    An equal key wins. Otherwise the first row in list order whose key starts
    the id, or starts with the id's first two dash-separated parts. Otherwise
    the default row.
    """
    by_key = _constant({row[0]: _entry(row, "exact") for row in prices}, f"map<string, {_ENTRY}>")
    in_order = _constant([_entry(row, "prefix") for row in prices], f"array<{_ENTRY}>")
    default = _constant(next(_entry(row, "default") for row in prices if row[0] == DEFAULT_PRICE_KEY), _ENTRY)
    family = F.substring_index(model, "-", 2)
    fits = F.filter(in_order, lambda p: model.startswith(p["key"]) | p["key"].startswith(family))
    return F.coalesce(F.try_element_at(by_key, model), F.get(fits, F.lit(0)), default)


def token_cost(tokens: Column, rate: Column, threshold: Column, rate_beyond: Column) -> Column:
    """USD for tokens at a rate per million; beyond a threshold the second rate applies."""
    first = F.least(tokens, threshold)  # a NULL threshold is skipped: flat price
    beyond = F.greatest(tokens - threshold, F.lit(0))
    return first / F.lit(1e6) * rate + F.coalesce(beyond / F.lit(1e6) * rate_beyond, F.lit(0.0))


def call_cost(price: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Cost of one call. Input and output are measured against the threshold separately."""
    return token_cost(
        prompt_tokens.cast("double"), price["input"], price["tier_threshold"].cast("double"), price["tier2_input"]
    ) + token_cost(
        completion_tokens.cast("double"),
        price["output"],
        price["tier_threshold"].cast("double"),
        price["tier2_output"],
    )


def with_cost(log: DataFrame, prices: Sequence[Sequence] = PRICES) -> DataFrame:
    """Add `price` and `cost` to rows with model, prompt_tokens and completion_tokens."""
    plain_id = F.replace(F.col("model"), F.lit("openai:"), F.lit(""))
    return log.withColumn("price", price_of(plain_id, prices)).withColumn(
        "cost", call_cost(F.col("price"), F.col("prompt_tokens"), F.col("completion_tokens"))
    )
