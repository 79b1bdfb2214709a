"""The SQL counterpart of each query, for DuckDB over the same tables."""

from __future__ import annotations

from checks.bindings import HEADED, QUOTED, RAW_CELLS, REQUESTS, RUN_LOG
from replylens.fixed_values import (
    BASE_MODELS,
    CHART_METRICS,
    DEFAULT_REPLY_KEYS,
    NA_TOKENS,
    PREFERRED_MODELS,
    PRICES,
    RANKED_METRICS,
    VERSIONED_MODELS,
)

# fixed values: the characters Python's str.strip() removes, for RE2
BLANK = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^{BLANK}+|{BLANK}+$', '', 'g')"


ONE_LINE = "translate(text, chr(10) || chr(13), '  ')"


def words(column: str) -> str:
    return f"len(list_filter(regexp_split_to_array({column}, '{BLANK}+'), lambda w: w <> ''))"


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


LOG = f"log AS ({RUN_LOG})"
_prices = _values((i, *row) for i, row in enumerate(PRICES))
PRICE = f"""price(ord, key, input, output, thr, in2, out2) AS (VALUES {_prices})"""
RESOLVED = """resolved AS (
  SELECT model, key, input, output, thr, in2, out2, how FROM (
    SELECT m.model, p.*, CASE WHEN p.key = m.model THEN 'exact'
             WHEN starts_with(m.model, p.key) OR starts_with(p.key, m.base) THEN 'prefix' ELSE 'default' END AS how,
           row_number() OVER (PARTITION BY m.model ORDER BY CASE WHEN p.key = m.model THEN 0
             WHEN starts_with(m.model, p.key) OR starts_with(p.key, m.base) THEN 1
             WHEN p.key = 'gpt-3.5-turbo' THEN 2 ELSE 3 END, p.ord) AS choice
    FROM (SELECT DISTINCT model, array_to_string(string_split(model, '-')[1:2], '-') AS base FROM log) m, price p)
  WHERE choice = 1)"""
PRICED = """priced AS (
  SELECT l.*, r.key, r.thr,
    (CASE WHEN r.thr IS NULL OR l.prompt_tokens <= r.thr THEN l.prompt_tokens / 1e6 * r.input
          ELSE r.thr / 1e6 * r.input + (l.prompt_tokens - r.thr) / 1e6 * r.in2 END)
    + (CASE WHEN r.thr IS NULL OR l.completion_tokens <= r.thr THEN l.completion_tokens / 1e6 * r.output
          ELSE r.thr / 1e6 * r.output + (l.completion_tokens - r.thr) / 1e6 * r.out2 END) AS cost
  FROM log l JOIN resolved r ON l.model = r.model)"""
COSTED = (LOG, PRICE, RESOLVED, PRICED)

PARSED = r"""spans AS (SELECT *, nullif(regexp_extract(response, '(?s)\{.*\}'), '') AS span FROM log),
valid AS (SELECT *, CASE WHEN span IS NOT NULL THEN json_valid(span) ELSE json_valid(response) END AS json_valid,
  CASE WHEN span IS NOT NULL AND json_valid(span) THEN span WHEN json_valid(response) THEN response END AS json_text
  FROM spans),
typed AS (SELECT *, json_type(json_text) AS kind FROM valid),
parsed AS (SELECT *,
  coalesce(CASE kind WHEN 'OBJECT' THEN len(json_keys(json_text)) > 0 WHEN 'ARRAY' THEN json_array_length(json_text) > 0
    WHEN 'VARCHAR' THEN json_text <> '""' WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN json_text = 'true'
    ELSE CAST(json_text AS DOUBLE) <> 0 END, false) AS json_truthy,
  CASE WHEN kind = 'OBJECT' AND len(json_keys(json_text)) > 0 THEN list_sort(list_distinct(json_keys(json_text))) END
    AS json_keys
  FROM typed)"""
EXPECTED = "[" + ", ".join(_literal(k) for k in DEFAULT_REPLY_KEYS) + "]"
SCORED = f"""scored AS (SELECT *, CASE WHEN json_keys IS NULL THEN 0.0
  ELSE len(list_intersect(json_keys, {EXPECTED})) / {float(len(DEFAULT_REPLY_KEYS))} END AS score FROM parsed)"""
# Every pair of key sets, straight from the definition.
STRUCTURE = """pairs AS (SELECT a.model, len(list_intersect(a.json_keys, b.json_keys))
    / CAST(len(list_distinct(list_concat(a.json_keys, b.json_keys))) AS DOUBLE) AS jaccard, a.n * b.n AS n
  FROM sets a JOIN sets b ON a.model = b.model AND array_to_string(a.json_keys, ',') < array_to_string(b.json_keys, ',')
  UNION ALL SELECT model, 1.0, n * (n - 1) / 2 FROM sets),
structure AS (SELECT model, coalesce(sum(jaccard * n) / nullif(sum(n), 0), 0) AS json_structure_consistency
  FROM pairs GROUP BY model)"""
SETS = """sets AS (SELECT model, json_keys, count(*) AS n FROM parsed WHERE json_keys IS NOT NULL GROUP BY ALL)"""

RUN_STATS = """stats AS (
  SELECT model, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS errors,
    count(*) AS total_reviews,
    CAST(coalesce(sum(prompt_tokens) FILTER (WHERE success), 0) AS DOUBLE) AS total_prompt_tokens,
    CAST(coalesce(sum(completion_tokens) FILTER (WHERE success), 0) AS DOUBLE) AS total_completion_tokens,
    CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (WHERE success), 0) AS DOUBLE) AS total_tokens,
    round(coalesce(avg(prompt_tokens) FILTER (WHERE success), 0), 6) AS avg_prompt_tokens,
    round(coalesce(avg(completion_tokens) FILTER (WHERE success), 0), 6) AS avg_completion_tokens,
    round(coalesce(avg(prompt_tokens + completion_tokens) FILTER (WHERE success), 0), 6) AS avg_tokens,
    round(coalesce(avg(latency) FILTER (WHERE success), 0), 6) AS average_latency
  FROM log GROUP BY model)"""


def basic(source: str, condition: str = "true") -> str:
    ok = f"FILTER (WHERE {condition})"
    return f"""basic AS (
  SELECT model, min(model_ord) AS model_ord, count(*) {ok} / CAST(count(*) AS DOUBLE) AS success_rate,
    coalesce(avg(latency) {ok}, 0) AS avg_latency, coalesce(avg(cost) {ok}, 0) AS avg_cost,
    coalesce(avg(cost) {ok}, 0) * 1000 AS cost_per_1000,
    coalesce(avg(prompt_tokens + completion_tokens) {ok}, 0) AS avg_tokens,
    coalesce(avg(prompt_tokens) {ok}, 0) AS avg_prompt_tokens,
    coalesce(avg(completion_tokens) {ok}, 0) AS avg_completion_tokens,
    CAST(coalesce(sum(prompt_tokens) {ok}, 0) AS DOUBLE) AS total_prompt_tokens,
    CAST(coalesce(sum(completion_tokens) {ok}, 0) AS DOUBLE) AS total_completion_tokens
  FROM {source} GROUP BY model)"""


BASIC_COLUMNS = (
    "success_rate", "avg_latency", "avg_cost", "cost_per_1000", "avg_tokens", "avg_prompt_tokens",
    "avg_completion_tokens", "total_prompt_tokens", "total_completion_tokens",
)
JSON_COLUMNS = (
    "json_validity", "valid_json_percentage", "format_consistency", "json_structure_consistency", "structural_accuracy",
)
QUALITY = """quality AS (
  SELECT model, avg(CAST(json_valid AS INT)) AS json_validity, avg(CAST(json_truthy AS INT)) * 100 AS valid_json_percentage,
    coalesce(avg(score) FILTER (WHERE json_truthy), 0) AS structural_accuracy
  FROM scored GROUP BY model)"""
# Every ordered pair of replies. Its similarity is twice the characters in matching blocks over all characters; the longest
# common run (the first in x, then in y) is a block, and what lies before and after it is matched in the same way.
ORDERED = """ordered AS (SELECT a.model, a.response AS x, b.response AS y, count(*) AS n
  FROM log a JOIN log b ON a.model = b.model AND a.pos < b.pos GROUP BY ALL)"""
RATIOS = """matches(x, y, a, b, size) AS (
  SELECT x, y, x, y, 0 FROM (SELECT DISTINCT x, y FROM ordered WHERE x <> y)
  UNION ALL
  SELECT x, y, unnest([substr(a, 1, i - 1), substr(a, i + k)]), unnest([substr(b, 1, j - 1), substr(b, j + k)]), unnest([k, 0])
  FROM (SELECT x, y, a, b, CAST(best.k AS INT) AS k, -best.before AS i, strpos(b, substr(a, -best.before, best.k)) AS j
    FROM (SELECT *, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2),
        lambda k: CASE WHEN contains(b, substr(a, i, k)) THEN {'k': k, 'before': -i} END)))) AS best
      FROM matches WHERE a <> '' AND b <> '') WHERE best IS NOT NULL)),
ratios AS (SELECT x, y, 2.0 * sum(size) / (length(x) + length(y)) AS ratio FROM matches GROUP BY x, y)"""
TEXTS = f"""{ORDERED},
{RATIOS},
consistency AS (SELECT model, sum(n * CASE WHEN o.x = o.y THEN 1.0 ELSE ratio END) / sum(n) AS format_consistency
  FROM ordered o LEFT JOIN ratios s ON o.x = s.x AND o.y = s.y GROUP BY model)"""
EVALUATION = """evaluation AS (
  SELECT b.*, q.json_validity, q.valid_json_percentage, coalesce(c.format_consistency, 0) AS format_consistency,
    coalesce(s.json_structure_consistency, 0) AS json_structure_consistency, q.structural_accuracy
  FROM basic b JOIN quality q ON b.model = q.model LEFT JOIN structure s ON b.model = s.model
    LEFT JOIN consistency c ON b.model = c.model)"""
EVALUATED = (*COSTED, PARSED, SCORED, SETS, STRUCTURE, TEXTS, basic("priced"), QUALITY, EVALUATION)


def rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_signs = {"avg_latency": "", "avg_cost": ""}
RANKED = (
    "metrics AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, model, model_ord, {_signs.get(m, '-')}round({m}, 12) AS k FROM evaluation"
        for m in RANKED_METRICS
    )
    + """),
ranked AS (SELECT metric, model, model_ord,
  CAST(row_number() OVER (PARTITION BY metric ORDER BY k, model_ord) AS INT) AS rank FROM metrics),
scores AS (SELECT model, model_ord, CAST(sum((SELECT count(*) FROM evaluation) - rank + 1) AS BIGINT) AS score
  FROM ranked GROUP BY model, model_ord),
overall AS (SELECT model, score, CAST(row_number() OVER (ORDER BY score DESC, model_ord) AS INT) AS rank FROM scores),
ranking AS (SELECT metric, model, rank FROM ranked UNION ALL SELECT 'overall', model, rank FROM overall)"""
)
RANKING = (*EVALUATED, RANKED)
CHOSEN = """chosen AS (SELECT max(model) FILTER (WHERE metric = 'overall' AND rank = 1) AS best_overall,
  string_agg(model, ',' ORDER BY rank) FILTER (WHERE metric = 'overall' AND rank <= 3) AS top_models,
  max(model) FILTER (WHERE metric = 'avg_cost' AND rank = 1) AS best_value,
  max(model) FILTER (WHERE metric = 'avg_latency' AND rank = 1) AS fastest,
  max(model) FILTER (WHERE metric = 'json_validity' AND rank = 1) AS most_accurate FROM ranking)"""
SUMMARY_METRICS = (
    "success_rate", "avg_latency", "avg_cost", "cost_per_1000", "json_validity", "format_consistency",
    "json_structure_consistency",
)
SUMMARY = f"""summary AS (SELECT s.model AS model_name, s.model AS full_name, {', '.join('e.' + m for m in SUMMARY_METRICS)},
  s.total_reviews, s.successful AS successful_reviews, s.errors AS error_count,
  CAST(trunc(s.avg_tokens) AS BIGINT) AS avg_tokens, CAST(trunc(s.avg_prompt_tokens) AS BIGINT) AS avg_input_tokens,
  CAST(trunc(s.avg_completion_tokens) AS BIGINT) AS avg_output_tokens,
  CAST(trunc(s.total_prompt_tokens) AS BIGINT) AS total_input_tokens,
  CAST(trunc(s.total_completion_tokens) AS BIGINT) AS total_output_tokens,
  CAST(trunc(s.total_tokens) AS BIGINT) AS total_tokens
  FROM stats s JOIN evaluation e ON s.model = e.model)"""
SUMMARISED = (*EVALUATED, RUN_STATS, SUMMARY)


def cost_text(value: str, precision: int) -> str:
    return f"""'$' || CASE WHEN {value} > 0 AND {value} < 0.0001 THEN format('{{:.6f}}', {value})
      WHEN {value} > 0 AND {value} < 0.01 THEN format('{{:.4f}}', {value})
      WHEN {value} = 0 THEN '0.0001' ELSE format('{{:.{precision}f}}', {value}) END"""


def response_cost(value: str) -> str:
    return f"""'$' || CASE WHEN {value} > 0 AND {value} < 0.000001 THEN format('{{:.8f}}', {value})
      ELSE format('{{:.6f}}', {value}) END"""


RAW = f"raw AS ({RAW_CELLS})"
NA = f"({', '.join(_literal(t) for t in NA_TOKENS)})"
PRESENT = f"present AS (SELECT * FROM raw WHERE review NOT IN {NA})"


def cleaned(source: str, rule: str) -> str:
    return f"""cleaned AS (SELECT * FROM (SELECT source, pos, {strip('review')} AS review FROM {source})
  WHERE review <> '' AND NOT ({rule}))"""


PREFIX_RULE = "starts_with(lower(review), 'review')"
CLEANED = (RAW, PRESENT, cleaned("present", PREFIX_RULE))
MODELS = f"""models(model_ord, model, provider, display_name, max_tokens, temperature) AS (VALUES {_values([
    *((i, r[0], r[1], r[2], r[4], r[6]) for i, r in enumerate(BASE_MODELS)),
    *((len(BASE_MODELS) + i, v, b[1], name or b[2], tokens or b[4], b[6])
      for i, (v, base, name, tokens) in enumerate(VERSIONED_MODELS) for b in BASE_MODELS if b[0] == base),
])})"""
REQ = f"req AS ({REQUESTS})"
BY_PREFIX = """CASE WHEN starts_with(model, 'gpt-') THEN 'openai' WHEN starts_with(model, 'claude-') THEN 'anthropic'
  WHEN starts_with(model, 'gemini-') THEN 'google' END"""
RUN = "run(model, model_ord) AS (VALUES ('gpt-4o', 0), ('claude-3-5-haiku-20241022', 1), ('gemini-2.5-pro', 2))"
PROMPT = r"'Rate this review: ' || text || chr(10) || 'Answer for ' || text || ' in JSON.'"
STUB = f"""asked AS (SELECT model, model_ord, doc_id AS pos, text, {PROMPT} AS prompt FROM documents, run),
answered AS (SELECT *, length(prompt) % 11 <> 0 AS success FROM asked),
log AS (SELECT model, model_ord, pos, text, success,
  CASE WHEN success THEN '{{"chars": ' || length(prompt) || '}}' ELSE 'Error: refused' END AS response,
  CASE WHEN NOT success THEN 0.0 WHEN length(prompt) % 2 = 1 THEN {words('prompt')} * CAST(1.3 AS DOUBLE)
    ELSE length(prompt) END AS prompt_tokens,
  CAST(CASE WHEN success THEN 7 ELSE 0 END AS DOUBLE) AS completion_tokens, 0.0 AS latency FROM answered)"""


# The report, one row per leaf: numbers in `number`, texts in `value`.
SUMMARY_COUNTS = (
    "total_reviews", "successful_reviews", "error_count", "avg_tokens", "avg_input_tokens", "avg_output_tokens",
    "total_input_tokens", "total_output_tokens", "total_tokens",
)
SUMMARY_TEXTS = {
    "model_name": "model_name",
    "full_name": "full_name",
    **{f"{c}_text": f"format('{{:.2f}}%', {c} * 100)" for c in ("success_rate", *SUMMARY_METRICS[4:])},
    "avg_latency_text": "format('{:.2f} seconds', avg_latency)",
    "avg_cost_text": cost_text("avg_cost", 6),
    "cost_per_1000_text": cost_text("cost_per_1000", 2),
}
SAMPLE_TEXTS = {"review": "review", "response": "response", "cost": response_cost("cost"), "latency": "format('{:.2f} seconds', latency)"}
REPORT = with_ctes(
    *RANKING, CHOSEN, RUN_STATS, SUMMARY,
    """samples AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY model ORDER BY NOT success, pos) = 1)""",
    select=" UNION ALL ".join([
        *(f"SELECT 'models' AS section, full_name AS key, '{c}' AS field, CAST(NULL AS VARCHAR) AS value, round(CAST({c} AS DOUBLE), 6) AS number FROM summary"
          for c in (*SUMMARY_METRICS, *SUMMARY_COUNTS)),
        *(f"SELECT 'models', full_name, '{c}', {e}, NULL FROM summary" for c, e in SUMMARY_TEXTS.items()),
        *(f"SELECT 'sample_responses', model, '{c}', {e}, NULL FROM samples" for c, e in SAMPLE_TEXTS.items()),
        "SELECT 'sample_responses', model, 'tokens', NULL, CAST(prompt_tokens + completion_tokens AS DOUBLE) FROM samples",
        *(f"SELECT 'recommendations', 'chosen', '{c}', {c}, NULL FROM chosen" for c in ("best_overall", "best_value", "fastest", "most_accurate")),
        "SELECT 'rankings', metric, 'order', string_agg(model, ',' ORDER BY rank), NULL FROM ranking GROUP BY metric",
        *(f"SELECT 'charts', '{chart}/{metric}', model, model, round({f'greatest({metric}, 0.00001)' if chart == 'cost' else metric}, 6) FROM evaluation"
          for chart, metric in CHART_METRICS),
        "SELECT 'head', 'report_20250102_030405', 'reviews.csv', '2025-01-02T03:04:05.000000', NULL",
    ]),
)


ORACLES: dict[str, str] = {
    # prices and cost
    "price_resolution": with_ctes(
        LOG, PRICE, RESOLVED,
        select="""SELECT l.model, r.key, r.how AS price_source, CAST(r.input AS DOUBLE) AS input,
          CAST(r.output AS DOUBLE) AS output, count(*) AS calls
          FROM log l JOIN resolved r ON l.model = r.model GROUP BY ALL""",
    ),
    "price_table_resolution": with_ctes(
        REQ, PRICE,
        """asked AS (SELECT model, replace(model, 'openai:', '') AS id, CAST(pos % 2 AS INT) AS version FROM req)""",
        """ranked AS (SELECT m.*, p.key, p.input, CASE WHEN p.key = m.id THEN 'exact' WHEN starts_with(m.id, p.key) OR starts_with(p.key, m.base) THEN 'prefix'
            ELSE 'default' END AS how, row_number() OVER (PARTITION BY m.id, m.version ORDER BY CASE WHEN p.key = m.id THEN 0
            WHEN starts_with(m.id, p.key) OR starts_with(p.key, m.base) THEN 1 WHEN p.key = 'gpt-3.5-turbo' THEN 2 ELSE 3 END,
            CASE m.version WHEN 0 THEN p.ord ELSE -p.ord END) AS choice
          FROM (SELECT DISTINCT id, version, array_to_string(string_split(id, '-')[1:2], '-') AS base FROM asked) m, price p)""",
        select="""SELECT a.model, a.version, r.key, r.how AS price_source, CAST(r.input AS DOUBLE) AS input, count(*) AS calls
          FROM asked a JOIN ranked r ON r.id = a.id AND r.version = a.version AND r.choice = 1 GROUP BY ALL""",
    ),
    "cost_flat": with_ctes(*COSTED, select="SELECT pos, round(cost, 10) AS cost FROM priced WHERE thr IS NULL"),
    "cost_tiered": with_ctes(*COSTED, select="SELECT pos, round(cost, 10) AS cost FROM priced WHERE thr IS NOT NULL"),
    # literal values, so that a wrong price list does not pass unseen: USD per million tokens, beyond 200,000 tokens the last two
    "cost_by_model": with_ctes(
        LOG,
        """literal(model, input, output, input2, output2) AS (VALUES ('gpt-4o', 5.0, 20.0, 5.0, 20.0),
          ('gpt-4o-2024-11-20', 30.0, 60.0, 30.0, 60.0), ('gpt-3.5-turbo', 0.5, 1.5, 0.5, 1.5), ('o1', 0.5, 1.5, 0.5, 1.5),
          ('claude-3-5-haiku-20241022', 3.0, 15.0, 3.0, 15.0), ('gemini-2.5-pro', 7.0, 21.0, 2.0, 6.0),
          ('gemini-2.0-flash-lite', 0.175, 0.525, 0.175, 0.525))""",
        select="""SELECT model, round(sum(least(prompt_tokens, 200000) / 1e6 * input + greatest(prompt_tokens - 200000, 0) / 1e6 * input2
            + least(completion_tokens, 200000) / 1e6 * output + greatest(completion_tokens - 200000, 0) / 1e6 * output2), 3) AS total_cost
          FROM log JOIN literal USING (model) GROUP BY model""",
    ),
    # statistics
    "run_stats": with_ctes(LOG, RUN_STATS, select="SELECT * FROM stats"),
    "running_stats": with_ctes(LOG, RUN_STATS, select="SELECT * FROM stats"),
    "eval_basic": with_ctes(
        *COSTED, basic("priced"), select=f"SELECT model, model_ord, {rounded(BASIC_COLUMNS)} FROM basic"
    ),
    "eval_basic_prefix": with_ctes(
        *COSTED, basic("priced", "NOT starts_with(response, 'Error:')"),
        select=f"SELECT model, model_ord, {rounded(BASIC_COLUMNS)} FROM basic",
    ),
    "eval_defaults": with_ctes(
        *COSTED, basic("priced"), MODELS,
        select=f"""SELECT m.model, m.model_ord,
          {', '.join(f'round(coalesce(b.{c}, 0), 6) AS {c}' for c in BASIC_COLUMNS)}
          FROM models m LEFT JOIN basic b ON m.model = b.model""",
    ),
    "evaluate_metrics": with_ctes(
        *EVALUATED, select=f"SELECT model, model_ord, {rounded(BASIC_COLUMNS + JSON_COLUMNS)} FROM evaluation"
    ),
    "running_evaluation": with_ctes(
        *EVALUATED, select=f"SELECT model, model_ord, {rounded(BASIC_COLUMNS + tuple(c for c in JSON_COLUMNS if c != 'format_consistency'))} FROM evaluation"
    ),
    "evaluate_all": with_ctes(
        *EVALUATED, select=f"SELECT model, model_ord, {rounded(BASIC_COLUMNS + JSON_COLUMNS)} FROM evaluation"
    ),
    # JSON
    "json_valid": with_ctes(LOG, PARSED, select="SELECT pos, json_valid FROM parsed"),
    "json_extract": with_ctes(LOG, PARSED, select="SELECT pos, json_text FROM parsed"),
    "json_truthy": with_ctes(LOG, PARSED, select="SELECT pos, json_truthy FROM parsed"),
    "json_key_sets": with_ctes(LOG, PARSED, select="SELECT pos, array_to_string(json_keys, ',') AS keys FROM parsed"),
    "structure_scores": with_ctes(LOG, PARSED, SCORED, select="SELECT pos, CAST(score AS DOUBLE) AS score FROM scored WHERE json_truthy"),
    "json_validity_by_model": with_ctes(*EVALUATED, select=f"SELECT model, {rounded(['json_validity'])} FROM evaluation"),
    "valid_json_percentage": with_ctes(
        *EVALUATED, select=f"SELECT model, {rounded(['valid_json_percentage'])} FROM evaluation"
    ),
    "structural_accuracy": with_ctes(
        *EVALUATED, select=f"SELECT model, {rounded(['structural_accuracy'])} FROM evaluation"
    ),
    "structure_consistency": with_ctes(
        LOG, PARSED, SETS, STRUCTURE, select=f"SELECT model, {rounded(['json_structure_consistency'])} FROM structure"
    ),
    # pairs of replies, compared and counted one by one
    "format_consistency_log": with_ctes(
        LOG, TEXTS, select="SELECT model, round(format_consistency, 6) AS format_consistency FROM consistency"
    ),
    "levenshtein_consistency": with_ctes(
        LOG, ORDERED,
        select="""SELECT model, round(sum(n * CASE WHEN x = y THEN 1 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END) / sum(n), 6)
          AS format_consistency FROM ordered GROUP BY model""",
    ),
    "sampled_consistency": with_ctes(
        LOG,
        "placed AS (SELECT model, response, row_number() OVER (PARTITION BY model ORDER BY pos) AS rank, count(*) OVER (PARTITION BY model) AS n FROM log)",
        "sizes AS (SELECT model, sum(c) AS n, sum(c * (c - 1) / 2) AS same FROM (SELECT model, response, count(*) AS c FROM log GROUP BY ALL) GROUP BY model)",
        """draws AS (SELECT model, ('0x' || substr(md5('pairs/one/' || k), 1, 14))::BIGINT % n + 1 AS one,
          ('0x' || substr(md5('pairs/other/' || k), 1, 14))::BIGINT % n + 1 AS other FROM sizes, range(1000) r(k))""",
        """ordered AS (SELECT d.model, a.response AS x, b.response AS y, count(*) AS n FROM draws d
          JOIN placed a ON a.model = d.model AND a.rank = least(one, other) JOIN placed b ON b.model = d.model AND b.rank = greatest(one, other)
          WHERE one <> other AND a.response <> b.response GROUP BY ALL)""",
        RATIOS,
        """sums AS (SELECT model, sum(n) AS m, sum(n * ratio) AS s, sum(n * ratio * ratio) AS q FROM ordered o
          JOIN ratios r ON o.x = r.x AND o.y = r.y GROUP BY model)""",
        select="""SELECT model, round((same + (n * (n - 1) / 2 - same) * s / m) / (n * (n - 1) / 2), 6) AS format_consistency,
          round(1.959964 * sqrt((q - s * s / m) / (m - 1) / m) * (n * (n - 1) / 2 - same) / (n * (n - 1) / 2), 6) AS half_width, CAST(m AS BIGINT) AS pairs
          FROM sizes JOIN sums USING (model)""",
    ),
    "pair_counts": with_ctes(
        LOG,
        select="""SELECT a.model, any_value(n.replies) AS replies, count(*) AS pairs
          FROM log a JOIN log b ON a.model = b.model AND a.pos < b.pos
          JOIN (SELECT model, count(*) AS replies FROM log GROUP BY model) n ON n.model = a.model GROUP BY a.model""",
    ),
    # ranking
    "metric_ranking": with_ctes(*RANKING, select="SELECT metric, model, rank FROM ranked"),
    "borda_overall": with_ctes(*RANKING, select="SELECT model, score, rank FROM overall"),
    "full_ranking": with_ctes(*RANKING, select="SELECT metric, model, rank FROM ranking"),
    "recommendations": with_ctes(*RANKING, CHOSEN, select="SELECT * FROM chosen"),
    # report tables
    "review_numbers": with_ctes(
        LOG,
        select="""SELECT model, row_number() OVER (PARTITION BY model ORDER BY pos) AS review_number,
          review AS review_text FROM log""",
    ),
    "all_responses": with_ctes(
        *COSTED,
        select=f"""SELECT model, row_number() OVER (PARTITION BY model ORDER BY pos) AS review_number,
          review AS review_text, prompt AS prompt_sent, response, success, prompt_tokens + completion_tokens AS tokens,
          round(cost, 10) AS cost, latency, {response_cost('cost')} AS cost_text,
          format('{{:.2f}} seconds', latency) AS latency_text FROM priced""",
    ),
    "sample_response": with_ctes(
        LOG,
        select="""SELECT model, pos, response, success FROM log
          QUALIFY row_number() OVER (PARTITION BY model ORDER BY NOT success, pos) = 1""",
    ),
    "top3_responses": with_ctes(
        LOG,
        select="""SELECT model, row_number() OVER (PARTITION BY model ORDER BY pos) AS review_number,
          greatest(count(*) OVER (PARTITION BY model) - 3, 0) AS more, review, response FROM log
          QUALIFY row_number() OVER (PARTITION BY model ORDER BY pos) <= 3""",
    ),
    "model_summary": with_ctes(
        *SUMMARISED,
        select=f"""SELECT * EXCLUDE ({', '.join(SUMMARY_METRICS)}), {rounded(SUMMARY_METRICS)},
          {', '.join(f"format('{{:.2f}}%', {c} * 100) AS {c}_text" for c in ('success_rate', *SUMMARY_METRICS[4:]))},
          format('{{:.2f}} seconds', avg_latency) AS avg_latency_text, {cost_text('avg_cost', 6)} AS avg_cost_text,
          {cost_text('cost_per_1000', 2)} AS cost_per_1000_text FROM summary""",
    ),
    "chart_data": with_ctes(
        *EVALUATED,
        select=" UNION ALL ".join(
            f"""SELECT '{chart}' AS chart, '{metric}' AS metric, model, model AS label,
              round({f'greatest({metric}, 0.00001)' if chart == 'cost' else metric}, 6) AS value FROM evaluation"""
            for chart, metric in CHART_METRICS
        ),
    ),
    "overview": with_ctes(
        *RANKING, CHOSEN, RUN_STATS,
        select="""SELECT 'reviews.csv' AS source_file, t.*, c.best_overall, c.best_value, c.fastest, c.most_accurate
          FROM (SELECT count(*) AS models_tested, CAST(sum(total_reviews) AS BIGINT) AS total_reviews FROM stats) t,
               chosen c""",
    ),
    "performance_table": with_ctes(
        *SUMMARISED,
        select=f"""SELECT model_name, full_name, {rounded(('success_rate', 'avg_latency', 'cost_per_1000'))}, total_tokens
          FROM summary""",
    ),
    "token_table": with_ctes(
        *SUMMARISED,
        select="""SELECT full_name, total_input_tokens, total_output_tokens, avg_input_tokens, avg_output_tokens
          FROM summary""",
    ),
    "report_doc": REPORT,
    "report_roundtrip": REPORT,
    "format_cost": with_ctes(
        *COSTED, "shrunk AS (SELECT pos, cost / pow(10.0, pos % 7) AS cost FROM priced)",
        select=f"""SELECT pos, {cost_text('cost', 6)} AS cost_text, {cost_text('cost', 2)} AS cost_short,
          {response_cost('cost')} AS response_cost FROM shrunk""",
    ),
    "format_texts": with_ctes(
        LOG,
        select="""SELECT pos, format('{:.2f} seconds', latency) AS latency_text,
          format('{:.2f}%', prompt_tokens / 300000 * 100) AS percent_text FROM log""",
    ),
    "timestamps": """SELECT event_id, strftime(ts, 'report_%Y%m%d_%H%M%S') AS report_name,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
      substring(replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'T', ' at '), 1, 19) AS shown_at FROM events""",
    # cleaning and browsing
    "clean_reviews": with_ctes(*CLEANED, select="SELECT pos, md5(review) AS review_md5 FROM cleaned"),
    "clean_equals_rule": with_ctes(
        RAW, cleaned("raw", "lower(review) = 'reviews'"), select="SELECT pos, md5(review) AS review_md5 FROM cleaned"
    ),
    "clean_text_rule": with_ctes(
        RAW, cleaned("raw", "false"), select="SELECT pos, md5(review) AS review_md5 FROM cleaned"
    ),
    "strip_quotes_flag": with_ctes(
        f"raw AS ({QUOTED})",
        "flags AS (SELECT source, arg_min(review LIKE '\"%\"', pos) AS quoted FROM raw GROUP BY source)",
        select="""SELECT source, pos, md5(CASE WHEN quoted THEN trim(review, '"') ELSE review END) AS review_md5
          FROM raw JOIN flags USING (source)""",
    ),
    "header_promotion": with_ctes(
        f"raw AS ({HEADED})",
        select="""SELECT source, pos, md5(review) AS review_md5 FROM raw
          QUALIFY NOT (row_number() OVER (PARTITION BY source ORDER BY pos) = 1 AND lower(review) = 'reviews')""",
    ),
    "na_tokens": with_ctes(
        RAW,
        select=f"""SELECT source, count(*) FILTER (WHERE review NOT IN {NA}) AS present, count(*) AS cells
          FROM raw GROUP BY source""",
    ),
    "limit_reviews": """SELECT source, doc_id AS pos, md5(text) AS review_md5 FROM documents
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100""",
    "search_reviews": "SELECT source, doc_id AS pos FROM documents WHERE contains(lower(text), 'tion')",
    "match_counts": """SELECT source, count(*) AS reviews, count(*) FILTER (WHERE contains(lower(text), 'tion')) AS matches,
      CAST(ceil(count(*) / 10) AS BIGINT) AS pages FROM documents GROUP BY source""",
    "limit_reviews_large": with_ctes(
        REQ,
        select="""SELECT source, pos, review FROM (SELECT CASE WHEN pos % 10 = 0 THEN 'rare' ELSE 'hot' END AS source,
            pos * 68719476736 AS pos, model AS review FROM req)
          QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) <= 5000""",
    ),
    "paginate": """SELECT source, pos, review_number, (review_number - 1) // 10 + 1 AS page,
      (review_number - 1) // 10 * 10 + 1 AS page_first,
      least((review_number - 1) // 10 * 10 + 10, total_reviews) AS page_last, total_reviews
      FROM (SELECT source, doc_id * 1099511627776 AS pos, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS review_number,
              count(*) OVER (PARTITION BY source) AS total_reviews FROM documents)""",
    "token_estimate": "SELECT doc_id AS pos, length(text) // 5 + 1 AS tokens FROM documents",
    "approx_tokens": f"SELECT doc_id AS pos, round({words('text')} * CAST(1.3 AS DOUBLE), 6) AS tokens FROM documents",
    "usage_fallback": f"""SELECT doc_id AS pos, round(CASE WHEN doc_id % 2 = 0 AND length(text) > 0 THEN length(text)
      ELSE {words('text')} * CAST(1.3 AS DOUBLE) END, 6) AS tokens FROM documents""",
    "preview": """SELECT doc_id AS pos, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END
      AS preview FROM documents""",
    "text_blocks": "SELECT conv_id, turn, md5(text || role) AS reply_md5 FROM conversations",
    # prompts and models
    "render_prompts": with_ctes(
        RUN, select=f"SELECT model, model_ord, doc_id AS pos, md5({PROMPT}) AS prompt_md5 FROM documents, run"
    ),
    "fan_out": with_ctes(RUN, select="SELECT model, model_ord, doc_id AS pos FROM documents, run"),
    "strip_provider": with_ctes(
        REQ,
        select="""SELECT pos, replace(model, 'openai:', '') AS plain,
          CASE WHEN contains(model, ':') THEN split_part(model, ':', 2) ELSE model END AS label FROM req""",
    ),
    "alias_resolution": with_ctes(
        REQ, MODELS, "plain AS (SELECT pos, model, replace(model, 'openai:', '') AS id FROM req)",
        select="""SELECT p.pos, p.model, CASE WHEN m.model IS NOT NULL THEN p.id
          WHEN id = 'gpt4' OR id = 'gpt-4' OR starts_with(id, 'gpt-4-') THEN 'gpt-4-turbo'
          WHEN id = 'gpt4o' OR id = 'gpt-4o-latest' THEN 'gpt-4o'
          WHEN id = 'gpt3.5' OR id = 'gpt-3.5' OR starts_with(id, 'gpt-3.5-') THEN 'gpt-3.5-turbo'
          ELSE 'gpt-4-turbo' END AS called_model
          FROM plain p LEFT JOIN models m ON m.model = p.id AND m.provider = 'openai'""",
    ),
    "provider_route": with_ctes(
        REQ,
        select="""SELECT pos, model, CASE WHEN starts_with(model, 'claude-') THEN 'anthropic'
          WHEN starts_with(model, 'gemini-') THEN 'google' ELSE 'openai' END AS provider FROM req""",
    ),
    "provider_lookup": with_ctes(
        REQ, MODELS,
        select=f"""SELECT pos, model, coalesce(m.provider, {BY_PREFIX}) AS provider, m.display_name,
          CAST(m.max_tokens AS INT) AS max_tokens, CAST(m.temperature AS DOUBLE) AS default_temperature,
          {BY_PREFIX} AS by_prefix FROM req LEFT JOIN models m USING (model)""",
    ),
    "models_by_provider": with_ctes(
        LOG, MODELS,
        select="""SELECT l.model, count(*) AS calls, CAST(any_value(m.model_ord) AS INT) AS model_ord
          FROM log l JOIN models m ON l.model = m.model
          WHERE m.provider = 'openai' AND contains(m.model, '-') GROUP BY l.model""",
    ),
    "display_names": with_ctes(
        REQ,
        """names(model, display_name) AS (VALUES ('gpt4', 'Gpt4'), ('gpt-4', 'Gpt-4'), ('gpt-4-foo', 'Gpt-4-Foo'),
          ('gpt4o', 'Gpt4O'), ('gpt-4o-latest', 'Gpt-4O-Latest'), ('gpt-3.5', 'Gpt-3.5'), ('gpt-3.5-foo', 'Gpt-3.5-Foo'),
          ('claude-3-opus-20240229', 'Claude 3 Opus'), ('gemini-2.5-flash-001', 'Gemini 2.5 Flash 001'),
          ('gpt-4-0613', 'Gpt-4-0613'), ('openai:gpt-4o-mini', 'Openai:Gpt-4O-Mini'), ('zzz', 'Zzz'))""",
        select="SELECT pos, display_name FROM req JOIN names USING (model)",
    ),
    "available_models": with_ctes(
        REQ, LOG, f"wanted(preferred_ord, model) AS (VALUES {_values(enumerate(PREFERRED_MODELS))})",
        select="""SELECT CAST(preferred_ord AS INT) AS preferred_ord, model FROM wanted
          WHERE model IN (SELECT model FROM req) OR model IN (SELECT model FROM log)""",
    ),
    # files
    "inspect_columns": """WITH head AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS sample_ord, *
        FROM documents ORDER BY doc_id LIMIT 3)
      SELECT 0 AS column_ord, 'doc_id' AS column_name, sample_ord, CAST(doc_id AS VARCHAR) AS value FROM head
      UNION ALL SELECT 1, 'lang', sample_ord, lang FROM head UNION ALL SELECT 2, 'source', sample_ord, source FROM head
      UNION ALL SELECT 3, 'n_chars', sample_ord, CAST(n_chars AS VARCHAR) FROM head
      UNION ALL SELECT 4, 'text', sample_ord, text FROM head""",
    "sample_lines": with_ctes(
        RAW,
        select=f"""SELECT pos, value FROM (SELECT pos, {strip('review')} AS value FROM raw) WHERE value <> ''
          ORDER BY pos LIMIT 3""",
    ),
    "column_by_index": with_ctes(*CLEANED, select="SELECT md5(review) AS review_md5 FROM cleaned"),
    "read_csv": with_ctes(*CLEANED, select="SELECT md5(review) AS review_md5 FROM cleaned"),
    "read_csv_headerless": with_ctes(*CLEANED, select="SELECT md5(review) AS review_md5 FROM cleaned"),
    "read_text_blocks": f"SELECT md5({strip('text')}) AS review_md5 FROM documents WHERE {strip('text')} <> ''",
    "read_text_split": f"SELECT md5({strip('text')}) AS review_md5 FROM documents WHERE {strip('text')} <> ''",
    "read_lines": with_ctes(
        "raw AS (SELECT source, doc_id AS pos, unnest(string_split(text, chr(10))) AS review FROM documents)",
        cleaned("raw", PREFIX_RULE),
        select="SELECT md5(review) AS review_md5 FROM cleaned",
    ),
    "read_ragged_csv": f"SELECT md5(text) AS review_md5 FROM documents WHERE {strip('text')} <> '' AND doc_id % 10 <> 3",
    "csv_fallback_chain": with_ctes(
        f"""d AS (SELECT doc_id, doc_id % 40 AS kind, text, {strip('text')} AS bare, {ONE_LINE} AS line FROM documents)""",
        "latin AS (SELECT doc_id || '  ' || regexp_replace(regexp_replace(line, '[^\\x00-\\xFF]', '?', 'g'), '[\\x80-\\xFF]', '', 'g') AS line FROM d WHERE kind = 5)",
        f"""found AS (SELECT bare AS review FROM d WHERE kind NOT IN (2, 3, 4, 5, 6)
          UNION ALL SELECT '"' || replace(line, '"', '""') || '",' FROM d WHERE kind = 2
          UNION ALL SELECT {strip('line')} FROM d WHERE kind = 3 AND bare <> '' AND NOT starts_with(lower(bare), 'review')
          UNION ALL SELECT line FROM d WHERE kind = 4 AND bare <> '' AND NOT starts_with(lower(bare), 'review')
          UNION ALL SELECT {strip('line')} FROM latin
          UNION ALL SELECT unnest(['id,feedback', doc_id || ',x', doc_id || ',x "' || replace(line, '"', '""') || '",z']) FROM d WHERE kind = 6)""",
        select="SELECT md5(review) AS review_md5 FROM found WHERE review <> ''",
    ),
    "dispatch_reviews": with_ctes(
        f"d AS (SELECT doc_id, {strip('text')} AS review, text FROM documents)",
        select=f"""SELECT CASE doc_id % 2 WHEN 0 THEN 'txt' ELSE 'csv' END AS kind, md5(review) AS review_md5 FROM d
          WHERE review <> '' AND (doc_id % 2 = 0 OR (text NOT IN {NA} AND NOT starts_with(lower(review), 'review')))""",
    ),
    "read_csv_repeated_names": with_ctes(*CLEANED, select="SELECT md5(review) AS review_md5 FROM cleaned"),
    "sheet_reviews": with_ctes(
        f"raw AS ({HEADED})",
        "rest AS (SELECT * FROM raw QUALIFY NOT (row_number() OVER (PARTITION BY source ORDER BY pos) = 1 AND lower(review) = 'reviews'))",
        f"present AS (SELECT * FROM rest WHERE review NOT IN {NA})",
        cleaned("present", "lower(review) = 'reviews'"),
        select="SELECT source, pos, md5(review) AS review_md5 FROM cleaned",
    ),
    "stage_roundtrip": with_ctes(
        RAW, cleaned("raw", PREFIX_RULE),
        select="""SELECT source, pos, md5(review) AS review_md5, 'reviews.csv' AS original_file,
          'review_text' AS selected_column, 'run-1' AS run_id FROM cleaned""",
    ),
    # scoring
    "score_stub": with_ctes(
        RUN, STUB, PRICE, RESOLVED, PRICED,
        select="""SELECT model, pos, model AS called_model, success, response, round(prompt_tokens, 10) AS prompt_tokens,
          completion_tokens, round(prompt_tokens + completion_tokens, 10) AS total_tokens, round(cost, 10) AS cost,
          CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS review_preview
          FROM priced""",
    ),
    "score_resumed": with_ctes(
        RUN,
        f"asked AS (SELECT model, model_ord, doc_id AS pos, text, {PROMPT} AS prompt FROM documents, run)",
        "known AS (SELECT *, pos % 3 = 0 AND length(prompt) % 5 <> 0 AS at_first FROM asked)",
        """log AS (SELECT model, model_ord, pos, true AS success, CASE WHEN at_first THEN 'first' ELSE 'second' END AS response,
          CAST(length(prompt) AS DOUBLE) AS prompt_tokens, CAST(CASE WHEN at_first THEN 1 ELSE 2 END AS DOUBLE) AS completion_tokens FROM known)""",
        PRICE, RESOLVED, PRICED,
        select="SELECT model, pos, success, response, prompt_tokens, completion_tokens, round(cost, 10) AS cost FROM priced",
    ),
    "score_sources": with_ctes(
        RUN,
        """log AS (SELECT model, model_ord, source, row_number() OVER (PARTITION BY model, source ORDER BY doc_id) AS source_pos,
          row_number() OVER (PARTITION BY model ORDER BY source, doc_id) AS pos,
          '{"grade": ' || (length(text) % 5) || '}' AS response FROM documents, run)""",
        TEXTS,
        select="""SELECT l.model, l.source, l.source_pos, l.pos AS review_number, l.response, f.source AS sample_source,
            f.source_pos AS sample_pos, round(c.format_consistency, 6) AS format_consistency
          FROM log l JOIN log f ON l.model = f.model AND f.pos = 1 JOIN consistency c ON c.model = l.model WHERE l.pos <= 3""",
    ),
    # literal values: what each provider is called with
    "score_settings": with_ctes(
        RUN,
        select="""SELECT model, doc_id AS pos, CASE model WHEN 'gpt-4o' THEN '0.7 2048' ELSE '0.1 500' END AS response
          FROM documents, run""",
    ),
    "exact_tokens": with_ctes(
        RUN,
        select=f"""SELECT model, doc_id AS pos, round(CASE WHEN model = 'gpt-4o' THEN CAST(len(string_split(text, 'e')) AS DOUBLE)
          ELSE {words('text')} * CAST(1.3 AS DOUBLE) END, 6) AS tokens FROM documents, run""",
    ),
    "score_retries": with_ctes(
        RUN,
        """asked AS (SELECT model, doc_id AS pos, length(CAST(doc_id AS VARCHAR) || ' ' || text) % 4 AS failures,
          CASE WHEN model = 'gpt-4o' THEN 1 ELSE 3 END AS attempts FROM documents, run)""",
        select="""SELECT model, pos, failures < attempts AS success,
          CASE WHEN failures < attempts THEN 'answered at attempt ' || (failures + 1) ELSE 'Error: busy' END AS response,
          CAST(CASE WHEN failures < attempts THEN 1 ELSE 0 END AS DOUBLE) AS completion_tokens FROM asked""",
    ),
    "score_written": with_ctes(
        RUN, STUB, RUN_STATS,
        select="""SELECT * EXCLUDE (average_latency, total_prompt_tokens, total_tokens),
          round(total_prompt_tokens, 6) AS total_prompt_tokens, round(total_tokens, 6) AS total_tokens FROM stats""",
    ),
}
