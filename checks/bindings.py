"""How the operators' inputs are derived from the driver's tables.

The SELECT lists below are valid in Spark and in DuckDB, so a query and its SQL
counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A response log: seven model ids, one per way a price is found; replies that are
# bare, wrapped and list JSON, plain text and errors.
RUN_LOG = """
SELECT CASE event_id % 7 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-2024-11-20' WHEN 2 THEN 'gpt-3.5-turbo'
         WHEN 3 THEN 'claude-3-5-haiku-20241022' WHEN 4 THEN 'gemini-2.5-pro'
         WHEN 5 THEN 'gemini-2.0-flash-lite' ELSE 'o1' END AS model,
       CAST(event_id % 7 AS INT) AS model_ord,
       event_id AS pos,
       event_type <> 'error' AS success,
       CASE event_type
         WHEN 'error'    THEN 'Error: upstream failure'
         WHEN 'click'    THEN props
         WHEN 'view'     THEN 'Here is the result: ' || props
         WHEN 'signup'   THEN '{"service": ' || props || ', "food": null' ||
                              CASE WHEN event_id % 2 = 0 THEN ', "value": 1}' ELSE '}' END
         ELSE CASE WHEN event_id % 3 = 0 THEN 'plain text' ELSE '[' || props || ']' END
       END AS response,
       CASE WHEN event_type = 'error' THEN 0 ELSE (event_id * 7919) % 300000 END AS prompt_tokens,
       CASE WHEN event_type = 'error' THEN 0 ELSE (event_id * 104729) % 250000 END AS completion_tokens,
       CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE value END AS latency,
       'visit by user ' || CAST(user_id AS VARCHAR(20)) AS review,
       'Summarise: visit by user ' || CAST(user_id AS VARCHAR(20)) AS prompt
FROM events
"""

# Requests under all kinds of model names.
REQUESTS = """
SELECT event_id AS pos,
       CASE user_id % 12 WHEN 0 THEN 'gpt4' WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'gpt-4-foo' WHEN 3 THEN 'gpt4o'
         WHEN 4 THEN 'gpt-4o-latest' WHEN 5 THEN 'gpt-3.5' WHEN 6 THEN 'gpt-3.5-foo'
         WHEN 7 THEN 'claude-3-opus-20240229' WHEN 8 THEN 'gemini-2.5-flash-001' WHEN 9 THEN 'gpt-4-0613'
         WHEN 10 THEN 'openai:gpt-4o-mini' ELSE 'zzz' END AS model
FROM events
"""

# Raw cells: every text of the table, in the states a review file brings.
RAW_CELLS = """
SELECT source, doc_id AS pos,
       CASE doc_id % 8 WHEN 0 THEN '  ' || text || chr(9) || chr(10) WHEN 1 THEN 'Review: ' || text
         WHEN 2 THEN chr(10) || 'REVIEWED ' || text WHEN 3 THEN NULL WHEN 4 THEN '   '
         WHEN 5 THEN 'N/A' WHEN 6 THEN ' Reviews ' ELSE text END AS review
FROM documents
"""

# Sources of which half quote every review.
QUOTED = """
SELECT source, doc_id AS pos,
       CASE WHEN length(source) = 5 OR doc_id % 5 = 0 THEN '"' || text || '"' ELSE text END AS review
FROM documents
"""

# Half of the sources begin with a row that only says what the column is.
HEADED = """
SELECT source, doc_id AS pos, text AS review FROM documents
UNION ALL
SELECT DISTINCT source, CAST(-1 AS BIGINT) AS pos, 'REVIEWS' AS review FROM documents WHERE length(source) = 5
UNION ALL
SELECT DISTINCT source, CAST(1000000000 AS BIGINT) AS pos, 'Reviews' AS review FROM documents
"""

REPLIES = """
SELECT CAST(conv_id % 3 AS INT) AS model_ord, 'model-' || CAST(conv_id % 3 AS VARCHAR(5)) AS model,
       conv_id * 1000 + turn AS pos, text AS response
FROM conversations WHERE role = 'assistant'
"""


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the statements above over the parquet tables of a folder."""
    for table in ("events", "documents", "conversations"):
        sql = sql.replace(f"FROM {table}", f"FROM parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(sql)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "SELECT source, doc_id AS pos, text AS review FROM documents")
