"""One query per operator, over its whole table with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.llm import chat, conversation_trie, decontaminate, html_text, line_dedup, packing, periodic_runs, pii, quality, simhash, toxicity, url_filter, warc
from replylens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        decontaminate.n_hit(F.col("found")).alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (decontaminate.n_hit(F.col("found")) > 0).alias("contaminated"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_chats(table(spark, sf_dir, "conversations")).drop("place")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.DEFAULT).alias("kept"),
        "failed",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


# rules of the URL query, and words in host names whose pages make up its list
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UNWANTED = ["ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam"]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table lists unwanted URLs, so the list is made of the pages on hosts with an unwanted word in a label."""
    pages = table(spark, sf_dir, "pages")
    labels = F.split(url_filter.host_of(F.col("url")), "[.-]")
    unwanted = pages.where(F.arrays_overlap(labels, F.array(*[F.lit(w) for w in UNWANTED])))
    listed = unwanted.select(url_filter.canonical(F.col("url")).alias("canonical")).distinct()
    return url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), listed)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.rebuilt(table(spark, sf_dir, "conversations"))
    return conversation_trie.nodes(*turns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")))
    best = periodic_runs.longest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_chat": op7_chat,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_text": op10_html_text,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_periodic_runs": op13_periodic_runs,
}
