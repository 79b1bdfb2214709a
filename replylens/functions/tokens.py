"""Counting tokens: the word estimate, or tokenizers plugged in per provider."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from replylens.functions.naming import route_provider
from replylens.functions.text import approx_tokens

Counter = Callable[[Column], Column]


def tokenizer_counter(encode: Callable[[str], Sequence]) -> Counter:
    """A counter from a tokenizer's `encode`; texts go through it in Arrow batches.

    A text the tokenizer cannot handle gets the word estimate instead.
    """

    @F.pandas_udf("double")
    def exact(texts: pd.Series) -> pd.Series:
        def size(text: str | None) -> float | None:
            try:
                return None if text is None else float(len(encode(text)))
            except Exception:
                return None

        return texts.map(size).astype("float64")

    return lambda text: F.coalesce(exact(text), approx_tokens(text))


def count_tokens(text: Column, model: Column, counters: Mapping[str, Counter] | None = None) -> Column:
    """Tokens of a text for a model, by its provider's counter or the word estimate."""
    counted = approx_tokens(text)
    for provider, counter in (counters or {}).items():
        counted = F.when(route_provider(model) == provider, counter(text)).otherwise(counted)
    return counted
