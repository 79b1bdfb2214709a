"""The corpus pipeline: each stage is one operator of replylens.llm on all its predecessor kept.

A stage reads the documents of the one before from Parquet in the shared folder, so that
a lost executor costs only the stage it was working on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.llm import decontaminate, line_dedup, packing, quality, simhash
from replylens.llm.common import stored, table, whole_row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the default policy, judged row by row."""
    whole = docs.select("doc_id", "text", whole_row(docs).alias("doc"))
    return quality.ledger(whole, carry=["doc"]).where(quality.passes(quality.DEFAULT)).select("doc.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that ten or more of them share."""
    kept = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return kept.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked fingerprints the document with the smallest doc_id; one without a doc_id if none has one.

    Of rows that share the smallest doc_id, the one whose columns have the smallest hash stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a hash skips nulls, so it takes in which columns are null
    row = F.xxhash64(*columns, *[c.isNull() for c in columns])
    whole = docs.select("doc_id", "text", row.alias("row"), whole_row(docs).alias("doc"))
    first = stored(simhash.survivors(whole), "kept-documents").toDF("kept_id", "kept_row")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row"))
    return whole.join(first.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "row"]).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    whole = docs.select("doc_id", "text", whole_row(docs).alias("doc"))
    found = decontaminate.scan(whole, table(spark, sf_dir, "benchmark"), carry=["doc"])
    return found.where(F.size("found.hits") == 0).select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their place in a training sequence."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# fingerprints and packing are not expressible in SQL; the tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
