"""From raw cells to reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.fixed_values import NA_TOKENS
from replylens.functions.text import is_header_like, strip_blank
from replylens.session import join_bounded

PREFIX_RULE = "prefix:review"
EQUALS_RULE = "equals:reviews"


def clean_reviews(
    df: DataFrame, header_rule: str | None = PREFIX_RULE, na_tokens: Sequence[str] = (), column: str = "review"
) -> DataFrame:
    """Trim, then drop missing cells, empty cells and leftover headers.

    `header_rule` is `prefix:review` for delimited files, `equals:reviews` for
    spreadsheets and None for plain text. `na_tokens` lists raw cell texts that
    count as missing.
    """
    if na_tokens:
        df = df.filter(~F.col(column).isin(*na_tokens))
    trimmed = df.withColumn(column, strip_blank(F.col(column)))
    return trimmed.filter((F.col(column) != "") & ~is_header_like(F.col(column), header_rule))


def nullify_na(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn the usual missing-value texts into NULL."""
    names = df.columns if columns is None else columns
    return df.withColumns({c: not_missing(F.col(f"`{c}`")) for c in names})


def is_quoted(text: Column) -> Column:
    return text.startswith('"') & text.endswith('"')


def without_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r'^"++|(?<!")"++$', "")


def not_missing(text: Column) -> Column:
    """The text, NULL where it is one of the usual missing-value texts."""
    return F.when(~text.isin(*NA_TOKENS), text)


def strip_quotes_if_first_quoted(df: DataFrame, keys: Sequence[str] = ("source",), pos: str = "pos") -> DataFrame:
    """Strip quotes off every review of a source whose first review is quoted.

    The flag compares two minima, so it is a hash aggregate over numbers; only
    sources that need stripping are joined back.
    """
    flagged = (
        df.groupBy(*keys)
        .agg(F.min(pos).alias("_first"), F.min(F.when(is_quoted(F.col("review")), F.col(pos))).alias("_first_quoted"))
        .filter(F.col("_first") == F.col("_first_quoted"))
        .select(*keys, F.lit(True).alias("_quoted"))
    )
    marked = join_bounded(df, flagged, list(keys), "left")
    stripped = without_quotes(F.col("review"))
    return marked.withColumn("review", F.when(F.col("_quoted"), stripped).otherwise(F.col("review"))).drop("_quoted")


def promote_header(
    df: DataFrame, keys: Sequence[str] = ("source",), pos: str = "pos", word: str = "reviews"
) -> DataFrame:
    """Drop the first row of a source when it only says `reviews`."""
    is_word = F.lower("review") == word
    first_is_word = (
        df.groupBy(*keys)
        .agg(F.min(pos).alias(pos), F.min(F.when(is_word, F.col(pos))).alias("_first_word"))
        .filter(F.col(pos) == F.col("_first_word"))
        .select(*keys, pos)
    )
    return join_bounded(df, first_is_word, [*keys, pos], "left_anti")
