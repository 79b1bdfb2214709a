"""The model registry and the price table as DataFrames.

Both have a fixed row count that does not depend on the data (36 and 25 rows),
which is what makes them safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.fixed_values import BASE_MODELS, PREFERRED_MODELS, PROVIDER_DEFAULTS, VERSIONED_MODELS

MODEL_SCHEMA = (
    "model_ord INT, model STRING, provider STRING, display_name STRING, description STRING, "
    "max_tokens INT, default_max_output_tokens INT, default_temperature DOUBLE"
)

def models(spark: SparkSession) -> DataFrame:
    """Base rows plus versioned rows, each a copy of its base with overrides."""
    base = spark.createDataFrame([(i, *row) for i, row in enumerate(BASE_MODELS)], MODEL_SCHEMA)
    variants = spark.createDataFrame(
        [(len(BASE_MODELS) + i, *row) for i, row in enumerate(VERSIONED_MODELS)],
        "variant_ord INT, variant STRING, model STRING, name_override STRING, tokens_override INT",
    )
    copied = variants.join(F.broadcast(base), "model").select(
        F.col("variant_ord").alias("model_ord"),
        F.col("variant").alias("model"),
        "provider",
        F.coalesce("name_override", "display_name").alias("display_name"),
        "description",
        F.coalesce("tokens_override", "max_tokens").alias("max_tokens"),
        "default_max_output_tokens",
        "default_temperature",
    )
    return base.unionByName(copied)


def provider_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PROVIDER_DEFAULTS,
        "provider STRING, system_prompt STRING, temperature DOUBLE, max_output_tokens INT",
    )


def models_by_provider(spark: SparkSession, provider: str) -> DataFrame:
    return models(spark).filter((F.col("provider") == provider) & F.col("model").contains("-"))


def preferred(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PREFERRED_MODELS)), "preferred_ord INT, model STRING")


def preferred_available(available: DataFrame) -> DataFrame:
    """Preferred models that occur in `available(model)`, in preferred order.

    The preferred list is the small fixed side, so the distinct models of a
    large log are filtered against it before they are compared.
    """
    wanted = F.broadcast(preferred(available.sparkSession))
    found = available.select("model").join(wanted, "model").groupBy("model", "preferred_ord").count()
    return found.select("preferred_ord", "model").orderBy("preferred_ord")
