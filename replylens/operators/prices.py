"""Prices from a table of any size, in one or many versions.

`functions.pricing` looks prices up in a list that is part of the plan. Here the list is a table, and the rule "the first key that
starts the id, or starts with its first two parts" becomes joins on equality: ids are joined by each of their beginnings, and keys are
listed under each of theirs with the first row that has it. Only distinct ids are looked up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.fixed_values import DEFAULT_PRICE_KEY, PRICES
from replylens.functions.pricing import call_cost
from replylens.functions.text import strip_provider
from replylens.session import durable, join_bounded

PRICE_SCHEMA = "ord INT, key STRING, input DOUBLE, output DOUBLE, tier_threshold BIGINT, tier2_input DOUBLE, tier2_output DOUBLE"
FIELDS = ("key", "input", "output", "tier_threshold", "tier2_input", "tier2_output")


def price_table(spark: SparkSession, prices: Sequence[Sequence] = PRICES) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(prices)], PRICE_SCHEMA)


def _beginnings(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def with_price_from(log: DataFrame, prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add `price` to rows with `model`, as `pricing.price_of` finds it, from a table like `price_table`.

    `ord` decides between rows of the table. `by` names columns that `log` and `prices` share, such as a version of the list; each
    value is a list of its own. Ids that no row fits get the row of the default key of their list, if it has one.
    """
    listed = prices.withColumn("_list", F.struct(F.lit(0), *by))
    asked = log.withColumns({"_list": F.struct(F.lit(0), *by), "_id": strip_provider(F.col("model"))})
    ids = durable(asked.select("_list", "_id").where("_id is not null").distinct())
    first = listed.groupBy("_list", "key").agg(F.min("ord").alias("ord"))
    equal = ids.join(first, [ids["_list"] == first["_list"], ids["_id"] == first["key"]]).select(ids["_list"], "_id", F.lit("exact").alias("how"), "ord")
    begun = ids.select("_list", "_id", F.explode(_beginnings(F.col("_id"))).alias("key")).join(first, ["_list", "key"])
    begins = first.select("_list", F.explode(_beginnings(F.col("key"))).alias("family"), "ord").groupBy("_list", "family").agg(F.min("ord").alias("ord"))
    related = ids.withColumn("family", F.substring_index("_id", "-", 2)).join(begins, ["_list", "family"])
    fitting = begun.select("_list", "_id", F.lit("prefix").alias("how"), "ord").unionByName(related.select("_list", "_id", F.lit("prefix").alias("how"), "ord"))
    best = equal.unionByName(fitting).groupBy("_list", "_id").agg(F.min(F.struct(F.col("how") != "exact", "ord", "how")).alias("best"))
    best = best.select("_list", "_id", "best.ord", "best.how")
    found = best.join(listed, ["_list", "ord"]).select("_list", "_id", F.struct(*FIELDS, F.col("how").alias("price_source")).alias("_found"))
    default = listed.where(F.col("key") == DEFAULT_PRICE_KEY).select("_list", F.struct(*FIELDS, F.lit("default").alias("price_source")).alias("_default"))
    priced = join_bounded(asked, found, ["_list", "_id"], "left")
    if by:
        priced = join_bounded(priced, default, ["_list"], "left")
    else:  # a single list has a single default row
        row, kinds = default.first(), {f.name: f.dataType for f in default.schema["_default"].dataType.fields}
        constant = F.struct(*[F.lit(row["_default"][n]).cast(k).alias(n) for n, k in kinds.items()]) if row else F.lit(None)
        priced = priced.withColumn("_default", constant)
    return priced.withColumn("price", F.coalesce("_found", "_default")).drop("_list", "_id", "_found", "_default")


def with_cost_from(log: DataFrame, prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add `price` and `cost` to rows with model, prompt_tokens and completion_tokens."""
    cost = call_cost(F.col("price"), F.col("prompt_tokens"), F.col("completion_tokens"))
    return with_price_from(log, prices, by).withColumn("cost", cost)
