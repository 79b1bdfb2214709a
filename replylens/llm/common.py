"""Pieces that several operators share: byte-exact text rules, stored intermediates, components."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.session import durable, scratch_path

# the six ASCII characters that separate words, as a regex class and as plain characters
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once below the shared folder and read back, so that lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that their names cannot clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _lower_ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links a-b: (node, root), root the smallest node reached.

    Alternates the large-star and small-star steps until the links no longer
    change; then each node hangs on its root. Both steps are a partial
    aggregate and an equi-join, whose hot keys AQE can split. Only nodes with
    a link to another node are returned. Links with a null end are ignored.
    """
    current = durable(_lower_ends(edges.where("a is not null and b is not null")))
    before = None
    while (now := _fingerprint(current)) != before:
        before = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = durable(_lower_ends(large))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        current = durable(_lower_ends(small))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
