"""Text expressions: trimming, previews, names and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters Python's str.strip() removes
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_blank(text: Column) -> Column:
    """Trim every kind of Unicode blank; `trim()` without a list knows only the space."""
    return F.trim(text, F.lit(_BLANKS))


def strip_leading(text: Column) -> Column:
    """Without the blanks before it. It looks at these alone, where `strip_blank` walks the whole text."""
    return F.ltrim(text, F.lit(_BLANKS))


def is_header_like(text: Column, rule: str | None) -> Column:
    """Rows that are a leftover header: `prefix:word`, `equals:word` or no rule."""
    if rule is None:
        return F.lit(False)
    kind, word = rule.split(":", 1)
    if kind == "prefix":
        # each character has at least one in lower case, so no more than these can matter
        return F.lower(F.substring(text, 1, len(word))).startswith(word)
    if kind == "equals":
        return F.lower(text) == F.lit(word)
    raise ValueError(f"unknown header rule: {rule}")


def preview(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def quick_token_estimate(text: Column) -> Column:
    """Integer estimate for display: a fifth of the characters, plus one."""
    return F.floor(F.length(text) / F.lit(5)).cast("bigint") + F.lit(1)


def word_count(text: Column) -> Column:
    """Runs of non-blank characters, counted in one pass without building them."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1C-\x1F]++"))


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, unrounded: the count used where no tokenizer is plugged in."""
    return word_count(text).cast("double") * F.lit(1.3)


def reported_or_approx(reported: Column, text: Column) -> Column:
    """Usage as reported by the provider, or the estimate where it reported none."""
    return F.when(F.coalesce(reported, F.lit(0)) == 0, approx_tokens(text)).otherwise(reported.cast("double"))


def render_prompt(template: str, review: Column) -> Column:
    """Put the review in place of every `{review}`; plain replacement, no regex."""
    return F.replace(F.lit(template), F.lit("{review}"), review)


def strip_provider(model: Column, provider: str = "openai") -> Column:
    return F.replace(model, F.lit(f"{provider}:"), F.lit(""))


def model_label(model: Column) -> Column:
    """The part after a provider prefix, or the whole id."""
    return F.coalesce(F.get(F.split(model, ":"), F.lit(1)), model)


def join_text_blocks(blocks: Column) -> Column:
    """Concatenate the text parts of a reply made of typed blocks."""
    texts = F.filter(blocks, lambda b: b["type"] == "text")
    return F.array_join(F.transform(texts, lambda b: F.coalesce(b["text"], F.lit(""))), "")


def title_case(text: Column) -> Column:
    """Capitalise each run of letters; `initcap` only looks at blanks."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def display_name(model: Column) -> Column:
    """Readable name derived from a model id."""
    dated = model.contains("-2025") | model.contains("-2024")
    spaced = F.replace(F.substring_index(model, "-2", 1), F.lit("-"), F.lit(" "))
    claude = F.when(dated, spaced).otherwise(F.replace(model, F.lit("claude-"), F.lit("Claude ")))
    return title_case(
        F.when(model.startswith("claude-"), claude)
        .when(model.startswith("gemini-"), F.replace(model, F.lit("-"), F.lit(" ")))
        .otherwise(F.replace(model, F.lit("gpt-"), F.lit("GPT-")))
    )


def fixed_decimals(value: Column, digits: int) -> Column:
    """Fixed-point text without grouping.

    `format_number` rounds the exact binary value half-even, as the published
    texts do (`format_string` would round ties up), except that it drops a
    value of exactly half a unit in the last place; that one is settled here.
    """
    half = float(f"5e-{digits + 1}")
    half_text = f"{half:.{digits}f}"
    text = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    return F.when(value == half, F.lit(half_text)).otherwise(text)


def format_cost(value: Column, precision: int = 6) -> Column:
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    digits = (
        F.when((number > 0) & (number < 0.0001), fixed_decimals(number, 6))
        .when((number > 0) & (number < 0.01), fixed_decimals(number, 4))
        .when(number == 0, F.lit("0.0001"))
        .otherwise(fixed_decimals(number, precision))
    )
    return F.concat(F.lit("$"), digits)


def format_response_cost(value: Column) -> Column:
    number = F.coalesce(value, F.lit(0.0))
    tiny = (number > 0) & (number < 0.000001)
    return F.concat(F.lit("$"), F.when(tiny, fixed_decimals(number, 8)).otherwise(fixed_decimals(number, 6)))


def format_seconds(value: Column) -> Column:
    return F.concat(fixed_decimals(F.coalesce(value, F.lit(0.0)), 2), F.lit(" seconds"))


def format_percent(share: Column) -> Column:
    return F.concat(fixed_decimals(F.coalesce(share, F.lit(0.0)) * 100, 2), F.lit("%"))


def report_name(at: Column) -> Column:
    return F.concat(F.lit("report_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def iso_timestamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def display_timestamp(iso: Column) -> Column:
    return F.substring(F.replace(iso, F.lit("T"), F.lit(" at ")), 1, 19)
