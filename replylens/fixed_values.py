"""Values that have to equal the published registry for results to agree.

Nothing in this file is computed; it is configuration, and callers may pass
their own lists wherever one of these is a default.
"""

# fixed values: model id prefix -> provider
PROVIDER_PREFIXES = (
    ("gpt-", "openai"),
    ("claude-", "anthropic"),
    ("gemini-", "google"),
)

# fixed values: model, provider, display name, description, context window,
# default maximum output tokens, default temperature
BASE_MODELS = (
    ("gpt-3.5-turbo", "openai", "GPT-3.5 Turbo", "Good balance of capabilities and cost", 16385, 2048, 0.7),
    ("gpt-4", "openai", "GPT-4", "More capable but slower and more expensive", 8192, 2048, 0.7),
    ("gpt-4o", "openai", "GPT-4o", "GPT-4 Omni - latest multimodal model", 32768, 4096, 0.7),
    ("gpt-4o-mini", "openai", "GPT-4o Mini", "Smaller, faster version of GPT-4o", 16385, 2048, 0.7),
    ("gpt-4.1", "openai", "GPT-4.1", "Improved version of GPT-4", 32768, 4096, 0.7),
    ("gpt-4.1-mini", "openai", "GPT-4.1 Mini", "Smaller, faster version of GPT-4.1", 16385, 2048, 0.7),
    ("gpt-4.1-nano", "openai", "GPT-4.1 Nano", "Smallest, fastest version of GPT-4.1", 8192, 1024, 0.7),
    ("claude-3-7-sonnet", "anthropic", "Claude 3.7 Sonnet", "Anthropic's mid-tier Claude 3.7 model", 200000, 4096, 0.5),
    ("claude-3-5-sonnet", "anthropic", "Claude 3.5 Sonnet", "Anthropic's mid-tier Claude 3.5 model", 200000, 4096, 0.5),
    ("claude-3-5-haiku", "anthropic", "Claude 3.5 Haiku", "Anthropic's fastest, most efficient Claude 3.5 model", 200000, 4096, 0.5),
    ("claude-3-haiku", "anthropic", "Claude 3 Haiku", "Anthropic's fastest, most efficient Claude 3 model", 200000, 4096, 0.5),
    ("claude-3-opus", "anthropic", "Claude 3 Opus", "Anthropic's most powerful Claude 3 model", 200000, 4096, 0.5),
    ("claude-2.1", "anthropic", "Claude 2.1", "Anthropic's Claude 2.1 model", 100000, 4096, 0.5),
    ("claude-2.0", "anthropic", "Claude 2.0", "Anthropic's Claude 2.0 model", 100000, 4096, 0.5),
    ("gemini-2.5-pro", "google", "Gemini 2.5 Pro", "Google's most capable Gemini model with tiered pricing", 1048576, 8192, 0.7),
    ("gemini-2.5-flash", "google", "Gemini 2.5 Flash", "Google's faster Gemini model", 1048576, 8192, 0.7),
    ("gemini-2.5-flash-lite", "google", "Gemini 2.5 Flash Lite", "Google's smaller, more efficient Gemini model", 1048576, 8192, 0.7),
    ("gemini-2.0-flash", "google", "Gemini 2.0 Flash", "Google's Gemini 2.0 model", 524288, 8192, 0.7),
    ("gemini-2.0-flash-lite", "google", "Gemini 2.0 Flash Lite", "Google's smaller Gemini 2.0 model", 524288, 8192, 0.7),
)

# fixed values: versioned id, the base row it copies, display name override,
# context window override
VERSIONED_MODELS = (
    ("gpt-4-0613", "gpt-4", None, None),
    ("gpt-4-32k-0613", "gpt-4", None, 32768),
    ("gpt-4-1106-preview", "gpt-4", "GPT-4 Turbo (Preview)", None),
    ("gpt-4-vision-preview", "gpt-4", "GPT-4 Vision (Preview)", None),
    ("gpt-3.5-turbo-0613", "gpt-3.5-turbo", None, None),
    ("gpt-3.5-turbo-16k-0613", "gpt-3.5-turbo", None, 16385),
    ("gpt-3.5-turbo-1106", "gpt-3.5-turbo", None, None),
    ("gpt-4.1-2025-04-14", "gpt-4.1", None, None),
    ("gpt-4o-2024-08-06", "gpt-4o", None, None),
    ("gpt-4o-mini-2024-07-18", "gpt-4o-mini", None, None),
    ("claude-3-7-sonnet-20250219", "claude-3-7-sonnet", None, None),
    ("claude-3-5-sonnet-20241022", "claude-3-5-sonnet", None, None),
    ("claude-3-5-sonnet-20240620", "claude-3-5-sonnet", None, None),
    ("claude-3-sonnet-20240229", "claude-3-5-sonnet", "Claude 3 Sonnet", None),
    ("claude-3-5-haiku-20241022", "claude-3-5-haiku", None, None),
    ("claude-3-haiku-20240307", "claude-3-haiku", None, None),
    ("claude-3-opus-20240229", "claude-3-opus", None, None),
)

# fixed values: key, input and output price in USD per million tokens, then for
# tiered rows the threshold and the two prices beyond it. The order decides
# which prefix wins, so rows must not be re-sorted.
PRICES = (
    ("gpt-3.5-turbo", 0.50, 1.50, None, None, None),
    ("gpt-4", 30.00, 60.00, None, None, None),
    ("gpt-4-0613", 30.00, 60.00, None, None, None),
    ("gpt-4o", 5.00, 20.00, None, None, None),
    ("gpt-4o-mini", 0.15, 0.60, None, None, None),
    ("gpt-4.1", 2.00, 8.00, None, None, None),
    ("gpt-4.1-mini", 0.40, 1.60, None, None, None),
    ("gpt-4.1-nano", 0.10, 0.40, None, None, None),
    ("gpt-4.1-2025-04-14", 2.00, 8.00, None, None, None),
    ("gpt-4o-2024-08-06", 5.00, 20.00, None, None, None),
    ("gpt-4o-mini-2024-07-18", 0.15, 0.60, None, None, None),
    ("claude-3-7-sonnet", 3.00, 15.00, None, None, None),
    ("claude-3-5-sonnet", 3.00, 15.00, None, None, None),
    ("claude-3-5-sonnet-20240620", 3.00, 15.00, None, None, None),
    ("claude-3-sonnet-20240229", 3.00, 15.00, None, None, None),
    ("claude-3-5-haiku", 0.80, 4.00, None, None, None),
    ("claude-3-haiku", 0.25, 1.25, None, None, None),
    ("claude-3-opus", 15.00, 75.00, None, None, None),
    ("claude-2.1", 8.00, 24.00, None, None, None),
    ("claude-2.0", 8.00, 24.00, None, None, None),
    ("gemini-2.5-pro", 7.00, 21.00, 200000, 2.00, 6.00),
    ("gemini-2.5-flash", 0.70, 2.10, None, None, None),
    ("gemini-2.5-flash-lite", 0.35, 1.05, None, None, None),
    ("gemini-2.0-flash", 0.35, 1.05, None, None, None),
    ("gemini-2.0-flash-lite", 0.175, 0.525, None, None, None),
)

# fixed value: the row that prices a model nothing else matches
DEFAULT_PRICE_KEY = "gpt-3.5-turbo"

# fixed values: models offered first, in display order
PREFERRED_MODELS = (
    "gpt-4",
    "gpt-4-0613",
    "gpt-4o",
    "gpt-4.1",
    "gpt-4.1-mini",
    "gpt-4o-mini",
    "gpt-3.5-turbo",
)

# fixed values: name parts that mark a text column; the first one wins outright
# when it is the whole name
TEXT_COLUMN_HINTS = (
    "review_text",
    "review",
    "text",
    "comment",
    "feedback",
    "content",
    "description",
    "reviews",
    "comments",
    "message",
)

# fixed values: cell texts that the CSV convention of pandas reads as missing
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# fixed values: the seven ranked metrics, in the order they are awarded
RANKED_METRICS = (
    "success_rate",
    "avg_latency",
    "avg_cost",
    "json_validity",
    "format_consistency",
    "json_structure_consistency",
    "structural_accuracy",
)

# fixed values: metrics where less is better
LOWER_IS_BETTER = ("avg_latency", "avg_cost")

# fixed values: chart -> metrics shown in it
CHART_METRICS = (
    ("cost", "cost_per_1000"),
    ("latency", "avg_latency"),
    ("success", "success_rate"),
    ("quality", "json_validity"),
    ("quality", "format_consistency"),
    ("quality", "json_structure_consistency"),
)

# fixed values: top-level keys of the reply that the default prompt asks for
DEFAULT_REPLY_KEYS = ("service", "food", "value", "environment", "availability")

# fixed values: provider -> system prompt, temperature, maximum output tokens
PROVIDER_DEFAULTS = (
    ("openai", "You are a helpful assistant that summarizes customer reviews.", 0.7, 2048),
    ("anthropic", None, 0.1, 500),
    ("google", None, 0.1, 500),
)

# fixed values: what a report shows where nothing was recorded
NO_REVIEW = "No review text available"
NO_PROMPT = "Prompt not recorded"
NO_RESPONSE = "No response available"
