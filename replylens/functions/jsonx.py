"""JSON checks on free-form replies, as column expressions.

Spark's JSON functions accept a valid value followed by anything at all. A text
counts as JSON here only if nothing follows it: it is wrapped into an array
together with its own hash, and the hash has to come back as the second element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brace_span(text: Column) -> Column:
    """From the first `{` to the last `}`, NULL when there is no such span.

    Plain searches rather than a greedy pattern, so unbalanced braces in a long
    text cannot make it quadratic.
    """
    start = F.instr(text, "{")
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))


def is_strict_json(text: Column) -> Column:
    # Failing to parse costs an exception per row; most prose is ruled out by how it begins.
    begins = text.rlike(r'^[ \t\n\r]*+([\[{"0-9-]|true|false|null)')
    mark = F.xxhash64(text)
    wrapped = F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))
    returned = F.try_variant_get(F.try_parse_json(wrapped), "$[1]", "bigint")
    return F.coalesce(F.when(begins, returned == mark), F.lit(False))


def is_truthy_json(valid: Column) -> Column:
    """Whether a valid JSON text holds more than an empty or zero value."""
    empty = valid.rlike(r'^\s*(\{\s*\}|\[\s*\]|""|null|false)\s*$')
    number = F.when(valid.rlike(r"^\s*[0-9-]"), F.trim(valid, F.lit(" \t\n\r")).try_cast("double"))
    return F.coalesce(~empty & (F.coalesce(number, F.lit(1.0)) != 0), F.lit(False))


def with_json(df: DataFrame, text: str = "response") -> DataFrame:
    """Add what the JSON metrics need, parsing each reply once per candidate.

    json_valid   the brace span parses, or the whole text if it has no span
    json_text    the span if it parses, else the whole text if that does
    json_truthy  json_text holds a non-empty value
    json_keys    sorted distinct top-level keys, NULL unless json_text is a
                 non-empty object
    """
    body = F.col(text)
    spans = df.withColumn("_span", brace_span(body))
    # One candidate is checked, and the whole text only where a span failed.
    first = spans.withColumn("_first_ok", is_strict_json(F.coalesce("_span", body)))
    retry = F.col("_span").isNotNull() & ~F.col("_first_ok")
    named = first.withColumn(
        "json_text",
        F.when(F.col("_first_ok"), F.coalesce("_span", body)).when(retry, F.when(is_strict_json(body), body)),
    )
    truthy = named.withColumn("json_truthy", is_truthy_json(F.col("json_text")))
    is_object = F.col("json_truthy") & F.ltrim(F.col("json_text"), F.lit(" \t\n\r")).startswith("{")
    keys = F.when(is_object, F.sort_array(F.array_distinct(F.json_object_keys("json_text"))))
    found = F.struct(F.col("_first_ok").alias("json_valid"), "json_text", "json_truthy", keys.alias("json_keys"))
    # A generator of one row: later filters stay above it, instead of being
    # rewritten into a second copy of the parsing.
    return truthy.select(*df.columns, F.inline(F.array(found)))


def structure_score(keys: Column, expected: Sequence[str]) -> Column:
    """Share of the expected top-level keys that are present; 0 for non-objects."""
    wanted = list(dict.fromkeys(expected))
    if not wanted:
        return F.lit(0.0)
    found = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in wanted])))
    return F.when(keys.isNull(), F.lit(0.0)).otherwise(found / F.lit(float(len(wanted))))
