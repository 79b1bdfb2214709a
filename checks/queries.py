"""One query per operator, each over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import HEADED, QUOTED, RAW_CELLS, REPLIES, REQUESTS, RUN_LOG, bind, reviews
from replylens import dims
from replylens.fixed_values import DEFAULT_REPLY_KEYS
from replylens.functions import text as tx
from replylens.functions.jsonx import structure_score, with_json
from replylens.functions.naming import provider_by_prefix, resolve_alias, route_provider
from replylens.functions.pricing import price_of, with_cost
from replylens.functions.tokens import count_tokens, tokenizer_counter
from replylens.operators import prices as price_tables
from replylens.operators import browse, cleaning, journal, numbering, pairwise, prompts, ranking, sampling, scoring, stats
from replylens.plans import report
from replylens.plans.evaluate import evaluate, evaluate_run
from replylens.session import prepare, scratch_path
from replylens.sources import columns, readers, sinks
from replylens.streaming import live_stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AT = datetime(2025, 1, 2, 3, 4, 5)
TEMPLATE = "Rate this review: {review}\nAnswer for {review} in JSON."
RUN_MODELS = ("gpt-4o", "claude-3-5-haiku-20241022", "gemini-2.5-pro")


def query(fn: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = prepared
    return prepared


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cost(bind(spark, sf_dir, RUN_LOG))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(run_log(spark, sf_dir), expected_keys=DEFAULT_REPLY_KEYS)


def evaluated_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return evaluate_run(run_log(spark, sf_dir), expected_keys=DEFAULT_REPLY_KEYS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def digest(column: str) -> Column:
    return F.md5(column).alias(f"{column}_md5")


# prices and cost


@query
def price_resolution(spark, sf_dir):
    log = bind(spark, sf_dir, RUN_LOG).withColumn("price", price_of(F.col("model")))
    return log.groupBy("model", "price.key", "price.price_source", "price.input", "price.output").agg(
        F.count(F.lit(1)).alias("calls")
    )


@query
def price_table_resolution(spark, sf_dir):
    """Requests under all kinds of names, with two versions of the price list as a table."""
    table = price_tables.price_table(spark)
    both = table.withColumn("version", F.lit(0)).unionByName(table.withColumns({"version": F.lit(1), "ord": -F.col("ord")}))
    asked = bind(spark, sf_dir, REQUESTS).withColumn("version", (F.col("pos") % 2).cast("int"))
    priced = price_tables.with_price_from(asked, both, ["version"])
    return priced.groupBy("model", "version", "price.key", "price.price_source", "price.input").agg(F.count(F.lit(1)).alias("calls"))


@query
def cost_flat(spark, sf_dir):
    log = run_log(spark, sf_dir).filter(F.col("price.tier_threshold").isNull())
    return log.select("pos", F.round("cost", 10).alias("cost"))


@query
def cost_tiered(spark, sf_dir):
    log = run_log(spark, sf_dir).filter(F.col("price.tier_threshold").isNotNull())
    return log.select("pos", F.round("cost", 10).alias("cost"))


@query
def cost_by_model(spark, sf_dir):
    return rounded(run_log(spark, sf_dir).groupBy("model").agg(F.sum("cost").alias("total_cost")), 3)


# statistics


@query
def run_stats(spark, sf_dir):
    return rounded(stats.run_stats(bind(spark, sf_dir, RUN_LOG)))


@query
def running_stats(spark, sf_dir):
    path, out, state = (scratch_path(spark, n) for n in ("responses", "stats", "state"))
    bind(spark, sf_dir, RUN_LOG).write.parquet(path)
    stream = live_stats.read_responses(spark, path, spark.read.parquet(path).schema)
    live_stats.write_stats(live_stats.running_stats(stream), out, state).awaitTermination()
    return rounded(spark.read.parquet(out))


@query
def running_evaluation(spark, sf_dir):
    """The metrics of a log that arrives in files, after the last of them."""
    path, out, state = (scratch_path(spark, n) for n in ("responses", "metrics", "state"))
    bind(spark, sf_dir, RUN_LOG).repartition(3, "pos").write.parquet(path)
    stream = live_stats.read_responses(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    live_stats.write_evaluation(live_stats.running_evaluation(stream, expected_keys=DEFAULT_REPLY_KEYS), out, state).awaitTermination()
    return rounded(live_stats.latest_evaluation(spark, out))


@query
def eval_basic(spark, sf_dir):
    return rounded(stats.eval_basic(run_log(spark, sf_dir)))


@query
def eval_basic_prefix(spark, sf_dir):
    return rounded(stats.eval_basic(run_log(spark, sf_dir), policy="prefix"))


@query
def eval_defaults(spark, sf_dir):
    models = dims.models(spark).select("model", "model_ord")
    return rounded(stats.with_eval_defaults(models, stats.eval_basic(run_log(spark, sf_dir))))


@query
def evaluate_metrics(spark, sf_dir):
    return rounded(evaluation(spark, sf_dir))


@query
def evaluate_all(spark, sf_dir):
    return rounded(evaluate(run_log(spark, sf_dir), expected_keys=DEFAULT_REPLY_KEYS))


# JSON


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_json(bind(spark, sf_dir, RUN_LOG))


@query
def json_valid(spark, sf_dir):
    return parsed_log(spark, sf_dir).select("pos", "json_valid")


@query
def json_extract(spark, sf_dir):
    return parsed_log(spark, sf_dir).select("pos", "json_text")


@query
def json_truthy(spark, sf_dir):
    return parsed_log(spark, sf_dir).select("pos", "json_truthy")


@query
def json_key_sets(spark, sf_dir):
    return parsed_log(spark, sf_dir).select("pos", F.array_join("json_keys", ",").alias("keys"))


@query
def structure_scores(spark, sf_dir):
    scored = parsed_log(spark, sf_dir).filter("json_truthy")
    return scored.select("pos", structure_score(F.col("json_keys"), DEFAULT_REPLY_KEYS).alias("score"))


@query
def json_validity_by_model(spark, sf_dir):
    return evaluation(spark, sf_dir).select("model", F.round("json_validity", 6).alias("json_validity"))


@query
def valid_json_percentage(spark, sf_dir):
    return evaluation(spark, sf_dir).select("model", F.round("valid_json_percentage", 6).alias("valid_json_percentage"))


@query
def structural_accuracy(spark, sf_dir):
    return evaluation(spark, sf_dir).select("model", F.round("structural_accuracy", 6).alias("structural_accuracy"))


@query
def structure_consistency(spark, sf_dir):
    return rounded(pairwise.structure_consistency(parsed_log(spark, sf_dir)))


# pairs of replies


@query
def format_consistency(spark, sf_dir):
    return rounded(pairwise.format_consistency(bind(spark, sf_dir, REPLIES)))


@query
def format_consistency_log(spark, sf_dir):
    return rounded(pairwise.format_consistency(bind(spark, sf_dir, RUN_LOG)))


@query
def levenshtein_consistency(spark, sf_dir):
    return rounded(pairwise.format_consistency(bind(spark, sf_dir, RUN_LOG), mode="levenshtein"))


@query
def sampled_consistency(spark, sf_dir):
    return rounded(sampling.sampled_consistency(bind(spark, sf_dir, RUN_LOG)))


@query
def pair_counts(spark, sf_dir):
    return pairwise.pair_counts(bind(spark, sf_dir, RUN_LOG))


# ranking


@query
def metric_ranking(spark, sf_dir):
    return ranking.rank_models(evaluation(spark, sf_dir)).select("metric", "model", "rank")


@query
def borda_overall(spark, sf_dir):
    return ranking.borda(ranking.rank_models(evaluation(spark, sf_dir))).select("model", "score", "rank")


@query
def full_ranking(spark, sf_dir):
    return ranking.full_ranking(evaluation(spark, sf_dir)).select("metric", "model", "rank")


@query
def recommendations(spark, sf_dir):
    chosen = ranking.recommendations(ranking.full_ranking(evaluation(spark, sf_dir)))
    return chosen.withColumn("top_models", F.array_join("top_models", ","))


# report tables


@query
def review_numbers(spark, sf_dir):
    return report.all_responses(run_log(spark, sf_dir).withColumn("total_tokens", F.lit(0))).select(
        "model", "review_number", "review_text"
    )


def priced_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return run_log(spark, sf_dir).withColumn("total_tokens", total)


@query
def all_responses(spark, sf_dir):
    sparse = priced_responses(spark, sf_dir).withColumn("pos", F.col("pos") * F.lit(2**36))
    table = report.all_responses(sparse, texts=True)
    return table.withColumn("cost", F.round("cost", 10))


@query
def sample_response(spark, sf_dir):
    return report.sample_response(priced_responses(spark, sf_dir)).select("model", "pos", "response", "success")


@query
def top3_responses(spark, sf_dir):
    top = report.top_responses(priced_responses(spark, sf_dir))
    return top.select("model", "review_number", "more", "review", "response")


@query
def model_summary(spark, sf_dir):
    evaluated, run = evaluated_run(spark, sf_dir)
    return rounded(report.model_summary(run, evaluated, texts=True))


@query
def chart_data(spark, sf_dir):
    return rounded(report.chart_data(evaluation(spark, sf_dir)))


@query
def overview(spark, sf_dir):
    evaluated, run = evaluated_run(spark, sf_dir)
    return report.overview(run, ranking.full_ranking(evaluated), "reviews.csv")


@query
def performance_table(spark, sf_dir):
    evaluated, run = evaluated_run(spark, sf_dir)
    return rounded(report.performance_table(report.model_summary(run, evaluated)))


@query
def token_table(spark, sf_dir):
    evaluated, run = evaluated_run(spark, sf_dir)
    return report.token_table(report.model_summary(run, evaluated))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = priced_responses(spark, sf_dir)
    evaluated, run = evaluated_run(spark, sf_dir)
    return report.report_document(
        run, evaluated, ranking.full_ranking(evaluated), report.sample_response(log), "reviews.csv", AT
    )


def _exploded(document: DataFrame) -> DataFrame:
    """A report as (section, key, field, value, number) rows, one per leaf."""

    def leaves(section: str, key: Column, struct: str, fields) -> Column:
        return F.array(*[
            F.struct(
                F.lit(section).alias("section"),
                key.alias("key"),
                F.lit(f.name).alias("field"),
                F.when(F.lit(f.dataType.typeName() == "string"), F.col(f"{struct}.{f.name}").cast("string")).alias("value"),
                F.when(F.lit(f.dataType.typeName() != "string"), F.round(F.col(f"{struct}.{f.name}").try_cast("double"), 6)).alias("number"),
            )
            for f in fields
        ])

    schema = document.schema
    parts = [
        document.select(F.explode(section).alias("key", "of")).select(
            F.inline(leaves(section, F.col("key"), "of", schema[section].dataType.valueType.fields))
        )
        for section in ("models", "sample_responses")
    ]
    chosen = [f for f in schema["recommendations"].dataType.fields if f.dataType.typeName() == "string"]
    parts.append(document.select(F.inline(leaves("recommendations", F.lit("chosen"), "recommendations", chosen))))
    none = F.lit(None).cast("double")
    parts.append(
        document.select(F.explode("rankings").alias("key", "models")).select(
            F.lit("rankings").alias("section"), "key", F.lit("order").alias("field"), F.array_join("models", ",").alias("value"), none.alias("number")
        )
    )
    parts.append(
        document.select(F.inline("charts")).select(
            F.lit("charts").alias("section"), F.concat("chart", F.lit("/"), "metric").alias("key"), F.col("model").alias("field"),
            F.col("label").alias("value"), F.round("value", 6).alias("number"),
        )
    )
    parts.append(
        document.select(F.lit("head").alias("section"), "report_name", "timestamp", "source_file").select(
            "section", F.col("report_name").alias("key"), F.col("source_file").alias("field"), F.col("timestamp").alias("value"), none.alias("number")
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def report_doc(spark, sf_dir):
    return _exploded(_report(spark, sf_dir))


@query
def report_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "reports")
    sinks.write_report(_report(spark, sf_dir), path)
    stored = readers.read_report(spark, path, "report_20250102_030405")
    return _exploded(stored)


@query
def format_cost(spark, sf_dir):
    priced = run_log(spark, sf_dir).withColumn("cost", F.col("cost") / F.pow(F.lit(10.0), (F.col("pos") % 7).cast("double")))
    return priced.select(
        "pos",
        tx.format_cost(F.col("cost")).alias("cost_text"),
        tx.format_cost(F.col("cost"), 2).alias("cost_short"),
        tx.format_response_cost(F.col("cost")).alias("response_cost"),
    )


@query
def format_texts(spark, sf_dir):
    log = bind(spark, sf_dir, RUN_LOG)
    return log.select(
        "pos",
        tx.format_seconds(F.col("latency")).alias("latency_text"),
        tx.format_percent(F.col("prompt_tokens") / 300000).alias("percent_text"),
    )


@query
def timestamps(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    iso = tx.iso_timestamp(F.col("ts"))
    return events.select(
        "event_id",
        tx.report_name(F.col("ts")).alias("report_name"),
        iso.alias("iso"),
        tx.display_timestamp(iso).alias("shown_at"),
    )


# cleaning and browsing


@query
def clean_reviews(spark, sf_dir):
    cleaned = cleaning.clean_reviews(cleaning.nullify_na(bind(spark, sf_dir, RAW_CELLS), ["review"]))
    return cleaned.select("pos", digest("review"))


@query
def clean_equals_rule(spark, sf_dir):
    cleaned = cleaning.clean_reviews(bind(spark, sf_dir, RAW_CELLS), cleaning.EQUALS_RULE)
    return cleaned.select("pos", digest("review"))


@query
def clean_text_rule(spark, sf_dir):
    cleaned = cleaning.clean_reviews(bind(spark, sf_dir, RAW_CELLS), None)
    return cleaned.select("pos", digest("review"))


@query
def strip_quotes_flag(spark, sf_dir):
    stripped = cleaning.strip_quotes_if_first_quoted(bind(spark, sf_dir, QUOTED))
    return stripped.select("source", "pos", digest("review"))


@query
def header_promotion(spark, sf_dir):
    return cleaning.promote_header(bind(spark, sf_dir, HEADED)).select("source", "pos", digest("review"))


@query
def na_tokens(spark, sf_dir):
    cells = cleaning.nullify_na(bind(spark, sf_dir, RAW_CELLS), ["review"])
    return cells.groupBy("source").agg(F.count("review").alias("present"), F.count(F.lit(1)).alias("cells"))


@query
def limit_reviews(spark, sf_dir):
    return browse.limit_reviews(reviews(spark, sf_dir)).select("source", "pos", digest("review"))


@query
def limit_reviews_large(spark, sf_dir):
    spread = F.col("pos") * F.lit(2**36)
    asked = bind(spark, sf_dir, REQUESTS).select(
        F.when(F.col("pos") % 10 == 0, "rare").otherwise("hot").alias("source"), spread.alias("pos"), F.col("model").alias("review")
    )
    return browse.limit_reviews(asked, 5000)


@query
def search_reviews(spark, sf_dir):
    return browse.search_reviews(reviews(spark, sf_dir), "TION").select("source", "pos")


@query
def match_counts(spark, sf_dir):
    found = F.lower("review").contains("tion")
    per_source = reviews(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(found).alias("matches")
    )
    return per_source.withColumn("pages", F.ceil(F.col("reviews") / browse.PAGE_SIZE).cast("bigint"))


@query
def paginate(spark, sf_dir):
    # positions need not be dense
    sparse = reviews(spark, sf_dir).withColumn("pos", F.col("pos") * F.lit(2**40))
    paged = browse.paginate(sparse)
    return paged.select("source", "pos", "review_number", "page", "page_first", "page_last", "total_reviews")


@query
def token_estimate(spark, sf_dir):
    return reviews(spark, sf_dir).select("pos", tx.quick_token_estimate(F.col("review")).alias("tokens"))


@query
def approx_tokens(spark, sf_dir):
    return rounded(reviews(spark, sf_dir).select("pos", tx.approx_tokens(F.col("review")).alias("tokens")))


@query
def usage_fallback(spark, sf_dir):
    reported = F.when(F.col("pos") % 2 == 0, F.length("review")).otherwise(F.lit(0))
    return rounded(
        reviews(spark, sf_dir).select("pos", tx.reported_or_approx(reported, F.col("review")).alias("tokens"))
    )


@query
def preview(spark, sf_dir):
    return reviews(spark, sf_dir).select("pos", tx.preview(F.col("review")).alias("preview"))


@query
def text_blocks(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")

    def block(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), body.alias("text"))

    blocks = F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.col("role")))
    return turns.select("conv_id", "turn", F.md5(tx.join_text_blocks(blocks)).alias("reply_md5"))


# prompts and models


@query
def render_prompts(spark, sf_dir):
    rendered = prompts.render_prompts(reviews(spark, sf_dir), RUN_MODELS, TEMPLATE)
    return rendered.select("model", "model_ord", "pos", digest("prompt"))


@query
def fan_out(spark, sf_dir):
    return prompts.fan_out(reviews(spark, sf_dir), RUN_MODELS).select("model", "model_ord", "pos")


@query
def strip_provider(spark, sf_dir):
    requests = bind(spark, sf_dir, REQUESTS)
    return requests.select(
        "pos", tx.strip_provider(F.col("model")).alias("plain"), tx.model_label(F.col("model")).alias("label")
    )


@query
def alias_resolution(spark, sf_dir):
    requests = bind(spark, sf_dir, REQUESTS)
    return requests.select("pos", "model", resolve_alias(tx.strip_provider(F.col("model"))).alias("called_model"))


@query
def provider_route(spark, sf_dir):
    return bind(spark, sf_dir, REQUESTS).select("pos", "model", route_provider(F.col("model")).alias("provider"))


@query
def provider_lookup(spark, sf_dir):
    requests = bind(spark, sf_dir, REQUESTS)
    looked_up = scoring.with_registry(requests)
    return looked_up.select("pos", "model", "provider", "display_name", "max_tokens", "default_temperature",
                            provider_by_prefix(F.col("model")).alias("by_prefix"))


@query
def models_by_provider(spark, sf_dir):
    used = bind(spark, sf_dir, RUN_LOG).groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    listed = dims.models_by_provider(spark, "openai").select("model", "model_ord")
    return used.join(F.broadcast(listed), "model").select("model", "calls", "model_ord")


@query
def display_names(spark, sf_dir):
    requests = bind(spark, sf_dir, REQUESTS)
    return requests.select("pos", tx.display_name(F.col("model")).alias("display_name"))


@query
def available_models(spark, sf_dir):
    return dims.preferred_available(bind(spark, sf_dir, REQUESTS).unionByName(
        bind(spark, sf_dir, RUN_LOG).select("pos", "model")))


# files


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, RAW_CELLS).select("pos", "source", F.col("review").alias("review_text"))


def _write_csv(df: DataFrame, path: str, header: bool) -> None:
    keep = dict(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df.write.options(header=header, escape='"', quoteAll=True, **keep).csv(path)


@query
def inspect_columns(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = documents.select(F.col("doc_id").alias("_pos"), "doc_id", "lang", "source", "n_chars", "text")
    return columns.sample_values(table)


@query
def sample_lines(spark, sf_dir):
    return columns.sample_lines(bind(spark, sf_dir, RAW_CELLS).select("pos", "review"))


@query
def column_by_index(spark, sf_dir):
    path = scratch_path(spark, "indexed")
    _write_csv(_cells(spark, sf_dir).select("pos", "review_text", "source"), path, True)
    return readers.reviews_from_column(readers.read_csv(spark, path), "1").select(digest("review"))


@query
def read_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    _write_csv(_cells(spark, sf_dir), path, True)
    return readers.read_csv_reviews(spark, path).select(digest("review"))


@query
def read_csv_headerless(spark, sf_dir):
    path = scratch_path(spark, "headerless")
    _write_csv(_cells(spark, sf_dir), path, False)
    return readers.read_csv_headerless(spark, path).select(digest("review"))


@query
def read_text_blocks(spark, sf_dir):
    path = scratch_path(spark, "blocks")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    texts.write.option("lineSep", "\n\n").option("maxRecordsPerFile", 200).text(path)
    return readers.read_text_reviews(spark, path).select(digest("review"))


@query
def read_text_split(spark, sf_dir):
    path = scratch_path(spark, "split")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    texts.write.option("lineSep", "\n\n").text(path)
    return readers.read_text_reviews(spark, path, whole_files=False).select(digest("review"))


@query
def read_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    labelled = F.concat(F.lit("Review "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(labelled.alias("value")).write.text(path)
    return readers.read_lines(spark, path).select(digest("review"))


@query
def read_ragged_csv(spark, sf_dir):
    path = scratch_path(spark, "ragged")
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('"'))
    # two or three cells, a hundred, or an empty one at the end
    extra = (
        F.when(F.col("doc_id") % 10 == 7, F.concat(F.repeat(F.lit("x,"), 98), quoted))
        .when(F.col("doc_id") % 10 == 3, F.concat(quoted, F.lit(",")))
        .when(F.col("doc_id") % 2 == 0, F.concat(F.col("lang"), F.lit(","), quoted))
        .otherwise(quoted)
    )
    rows = F.concat(F.col("source"), F.lit(","), extra)
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(rows.alias("value")).write.text(path)
    return readers.read_ragged_csv(spark, path).select(digest("review"))


def _one_line(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def _in_quotes(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))


def _write_headed(df: DataFrame, path: str) -> None:
    """Quoted cells, the header with the first row of a task: a task without rows writes none, as a file that is nothing but a header would be read."""
    cells = [_in_quotes(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    first = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0
    header = F.when(first, ",".join(f'"{c}"' for c in df.columns) + "\n").otherwise("")
    df.select(F.concat(header, F.concat_ws(",", *cells)).alias("value")).write.text(path)


# rows of a file that is judged on its own: the files of a folder grow in number with the table, and far less than its rows
FILE_ROWS = 200


def _write_files(spark: SparkSession, df: DataFrame, text: Column, name: str) -> str:
    path = scratch_path(spark, name)
    df.select(text.alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).text(path)
    return path


@query
def csv_fallback_chain(spark, sf_dir):
    """Every document in a file for which one of the ways of reading wins."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kind", F.col("doc_id") % 40)
    number, text, line = F.col("doc_id").cast("string"), F.col("text"), _one_line(F.col("text"))
    headed, alone = scratch_path(spark, "headed"), scratch_path(spark, "alone")
    _write_headed(documents.filter("kind = 0 or kind > 6").select("doc_id", text.alias("feedback")), headed)
    # the column that a hint in the first row names holds nothing but labels
    labelled = documents.filter("kind = 1").select(F.concat(F.lit("Review "), number), "text")
    labelled.write.options(header=False, escape='"', quoteAll=True, maxRecordsPerFile=FILE_ROWS).csv(alone)
    latin = F.concat(number, F.lit(" \u00e9 "), F.regexp_replace(line, "[^\\x00-\\xFF]", "?"))
    of_kind = {
        # the named cell, which is the last one, is empty or a label, so lines count
        2: F.concat(F.lit("Review,review_text\n"), _in_quotes(line), F.lit(",")),
        # wider than the rows before, and all lines begin like labels: the first cell that does not, or the last one
        3: F.concat(F.lit("Review a\nReview b\nReview c,"), _in_quotes(line)),
        4: F.concat(F.lit("Review a,Review b\nReview c,Review d\nReview e,x,"), _in_quotes(line)),
        # bytes that are not UTF-8
        5: F.encode(latin, "ISO-8859-1").cast("string"),
        # a row wider than header and first row
        6: F.concat(F.lit("id,feedback\n"), number, F.lit(",x\n"), number, F.lit(",x "), _in_quotes(line), F.lit(",z")),
    }
    paths = [_write_files(spark, documents.filter(F.col("kind") == k), value, f"chain-{k}") for k, value in of_kind.items()]
    return readers.csv_with_fallbacks(spark, [headed, alone, *paths]).select(digest("review"))


@query
def dispatch_reviews(spark, sf_dir):
    """Half of the documents as a text file, half as a delimited one, read by their extension."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, cells = f"{scratch_path(spark, 'mixed')}.txt", f"{scratch_path(spark, 'mixed')}.csv"
    documents.filter("doc_id % 2 = 0").select("text").write.option("lineSep", "\n\n").option("maxRecordsPerFile", 200).text(texts)
    _write_headed(documents.filter("doc_id % 2 = 1").select("doc_id", F.col("text").alias("text"), F.col("text").alias("text_again")), cells)
    every = [readers.read_reviews(spark, p).withColumn("kind", F.lit(readers.extension(p))) for p in (texts, cells)]
    return every[0].unionByName(every[1]).select("kind", digest("review"))


@query
def read_csv_repeated_names(spark, sf_dir):
    """Files whose header has one name three times; the third column is read."""
    path = scratch_path(spark, "repeated")
    row = F.concat_ws(",", "pos", "source", _in_quotes(F.coalesce("review", F.lit(""))))
    first = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0
    headed = F.concat(F.when(first, "feedback,feedback,feedback\n").otherwise(""), row)
    bind(spark, sf_dir, RAW_CELLS).select(headed.alias("value")).write.text(path)
    return readers.reviews_from_column(readers.read_csv(spark, path), "feedback.2").select(digest("review"))


@query
def sheet_reviews(spark, sf_dir):
    sheet = bind(spark, sf_dir, HEADED).select(F.col("source").alias("_file"), F.col("pos").alias("_pos"), F.col("review").alias("body"))
    return readers.read_sheet_reviews(sheet).select("source", "pos", digest("review"))


@query
def stage_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "staged")
    cleaned = cleaning.clean_reviews(bind(spark, sf_dir, RAW_CELLS))
    sinks.stage_reviews(cleaned, path, "run-1", AT, "reviews.csv", "review_text")
    staged = readers.read_staged(spark, path, "run-1")
    return staged.select("source", "pos", digest("review"), "original_file", "selected_column", "run_id")


# scoring


def _count_letters(model: str, prompt: str, settings: dict) -> tuple:
    if len(prompt) % 11 == 0:
        raise RuntimeError("refused")
    return json.dumps({"chars": len(prompt)}), 0 if len(prompt) % 2 else len(prompt), 7


class _Flaky:
    """Fails a number of times that depends on the prompt, then answers."""

    def __init__(self):
        self.seen = {}

    def __call__(self, model: str, prompt: str, settings: dict) -> tuple:
        key = (model, prompt)
        self.seen[key] = self.seen.get(key, 0) + 1
        if self.seen[key] <= len(prompt) % 4:
            raise scoring.ServerError("busy")
        return f"answered at attempt {self.seen.pop(key)}", len(prompt), 1


def _no_sleep(_: float) -> None:
    return None


# the usual policies, without waiting between attempts
RETRIES = {
    "anthropic": scoring.Retry(on=(scoring.CallTimeout, scoring.ServerError), sleep=_no_sleep),
    "google": scoring.Retry(on=(Exception,), sleep=_no_sleep),
}


@query
def score_stub(spark, sf_dir):
    scored = scoring.score(reviews(spark, sf_dir), RUN_MODELS, TEMPLATE, _count_letters, RETRIES, concurrency=16)
    return rounded(
        scored.select("model", "pos", "called_model", "success", "response", "prompt_tokens", "completion_tokens",
                      "total_tokens", "cost", "review_preview"), 10
    )


def _grade(model: str, prompt: str, settings: dict) -> tuple:
    return json.dumps({"grade": len(prompt) % 5}), len(prompt), 3


@query
def score_sources(spark, sf_dir):
    """Reviews numbered within each source, through a run and what reads its order."""
    numbered = numbering.number_rows(reviews(spark, sf_dir), ["source"], name="line").withColumn("pos", F.col("line")).drop("line")
    asked = numbering.run_positions(numbered)
    answers = sinks.write_responses(scoring.score(asked, RUN_MODELS, "{review}", _grade, RETRIES), scratch_path(spark, "answers"))
    top = report.top_responses(answers).select("model", "source", "source_pos", "review_number", "response")
    sample = report.sample_response(answers).select("model", F.col("source").alias("sample_source"), F.col("source_pos").alias("sample_pos"))
    consistency = rounded(pairwise.format_consistency(answers))
    return top.join(sample, "model").join(consistency, "model")


def _settings(model: str, prompt: str, settings: dict) -> tuple:
    return f"{settings['temperature']} {settings['max_output_tokens']}", 1, 1


@query
def score_settings(spark, sf_dir):
    scored = scoring.score(reviews(spark, sf_dir), RUN_MODELS, TEMPLATE, _settings, RETRIES, concurrency=16)
    return scored.select("model", "pos", "response")


def _split_at_e(text: str) -> list[str]:
    return text.split("e")


@query
def exact_tokens(spark, sf_dir):
    counters = {"openai": tokenizer_counter(_split_at_e)}
    asked = prompts.fan_out(reviews(spark, sf_dir), RUN_MODELS)
    return rounded(asked.select("model", "pos", count_tokens(F.col("review"), F.col("model"), counters).alias("tokens")))


@query
def score_retries(spark, sf_dir):
    # position in the prompt keeps copies of a text apart
    numbered = reviews(spark, sf_dir).withColumn("review", F.concat(F.col("pos").cast("string"), F.lit(" "), "review"))
    scored = scoring.score(numbered, RUN_MODELS, "{review}", _Flaky(), RETRIES)
    return scored.select("model", "pos", "success", "response", "completion_tokens")


def _first_run(model: str, prompt: str, settings: dict) -> tuple:
    if len(prompt) % 5 == 0:
        raise RuntimeError("refused")
    return "first", len(prompt), 1


def _second_run(model: str, prompt: str, settings: dict) -> tuple:
    return "second", len(prompt), 2


@query
def score_resumed(spark, sf_dir):
    """A run over a third of the reviews, then over all: calls that are known are not made again, but for failures."""
    run = journal.Journal(scratch_path(spark, "journal"), "run-1")
    texts = reviews(spark, sf_dir)
    scoring.score_resumable(texts.where("pos % 3 = 0"), RUN_MODELS, TEMPLATE, _first_run, run, RETRIES)
    scored = scoring.score_resumable(texts, RUN_MODELS, TEMPLATE, _second_run, run, RETRIES, repeat_failures=True)
    return rounded(scored.select("model", "pos", "success", "response", "prompt_tokens", "completion_tokens", "cost"), 10)


@query
def score_written(spark, sf_dir):
    scored = scoring.score(reviews(spark, sf_dir), RUN_MODELS, TEMPLATE, _count_letters, RETRIES, concurrency=16)
    stored = sinks.write_responses(scored, scratch_path(spark, "responses"))
    return rounded(stats.run_stats(stored).drop("average_latency"))
