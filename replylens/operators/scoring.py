"""Calling models from Spark tasks.

How a provider is reached is the caller's business: a run is given a function
`call(model, prompt, settings) -> (text, prompt_tokens, completion_tokens)` that
raises on failure. What happens around it (retries, timing, error rows) is here.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens import dims
from replylens.functions.naming import provider_by_prefix, resolve_alias, route_provider
from replylens.functions.pricing import with_cost
from replylens.functions.text import preview, render_prompt, strip_provider
from replylens.functions.tokens import Counter, count_tokens
from replylens.operators.journal import ANSWER, Journal
from replylens.operators.prompts import check_run, fan_out, render_prompts
from replylens.session import durable

Call = Callable[[str, str, dict], tuple]


class CallTimeout(Exception):
    """The provider did not answer in time."""


class ServerError(Exception):
    """The provider answered with a 5xx status."""


@dataclass(frozen=True)
class Retry:
    """Attempts per call; the delay doubles after each one."""

    attempts: int = 3
    delay: float = 1.0
    on: tuple[type[BaseException], ...] = ()
    sleep: Callable[[float], None] = time.sleep


# fixed values: which failures each provider's calls are repeated for
DEFAULT_RETRIES = {
    "openai": Retry(attempts=1),
    "anthropic": Retry(on=(CallTimeout, ServerError)),
    "google": Retry(on=(Exception,)),
}

# so many reviews per task keep all tasks about equally busy
REVIEWS_A_TASK = 32

# names that a column carried along with the reviews cannot have
_ANSWER_COLUMNS = {
    "model", "model_ord", "called_model", "provider", "review_preview", "prompt", "success", "response", "prompt_tokens",
    "completion_tokens", "total_tokens", "latency", "total_time", "cost", "price", "system_prompt", "temperature",
    "max_output_tokens", "refusal", "reported_prompt_tokens", "reported_completion_tokens",
}


def call_with_retry(call: Call, retry: Retry, model: str, prompt: str, settings: dict) -> tuple:
    delay = retry.delay
    for attempt in range(1, retry.attempts + 1):
        try:
            return call(model, prompt, settings)
        except retry.on:
            if attempt == retry.attempts:
                raise
            retry.sleep(delay)
            delay *= 2
    raise ValueError("a call needs at least one attempt")


def _answer(call: Call, retry: Retry, model: str, prompt: str, settings: dict) -> dict:
    started = time.monotonic()
    try:
        text, prompt_tokens, completion_tokens = call_with_retry(call, retry, model, prompt, settings)
    except Exception as failure:  # any failure becomes a row of the result
        spent = time.monotonic() - started
        return dict(success=False, response=f"Error: {failure}", reported_prompt_tokens=0.0,
                    reported_completion_tokens=0.0, latency=0.0, total_time=spent)
    spent = time.monotonic() - started
    return dict(success=not text.startswith("Error:"), response=text,
                reported_prompt_tokens=float(prompt_tokens or 0),
                reported_completion_tokens=float(completion_tokens or 0),
                latency=spent, total_time=spent)


def with_settings(requests: DataFrame) -> DataFrame:
    """Attach the provider and its defaults to each request (three fixed rows)."""
    routed = requests.withColumn("provider", route_provider(F.col("model")))
    return routed.join(F.broadcast(dims.provider_defaults(requests.sparkSession)), "provider", "left")


def with_registry(log: DataFrame) -> DataFrame:
    """Attach registry fields; unregistered ids get a provider from their prefix, if any."""
    registry = dims.models(log.sparkSession).drop("model_ord")
    joined = log.join(F.broadcast(registry), "model", "left")
    return joined.withColumn("provider", F.coalesce("provider", provider_by_prefix(F.col("model"))))


def score(
    reviews: DataFrame,
    models: Sequence[str],
    template: str,
    call: Call,
    retries: dict[str, Retry] | None = None,
    counters: Mapping[str, Counter] | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """Run every review through every model and price the answers.

    The number of partitions is the number of calls in flight. A task that is
    retried calls the provider again, so write the result before analysing it
    (`sinks.write_responses`). `counters` holds token counters per provider, for
    usage a provider did not report; the others are estimated from words.
    Further columns of `reviews`, such as `source`, stay with their answers. What
    compares or numbers answers needs a `pos` that is unique in the run: give reviews of
    several files one with `numbering.run_positions` first.
    """
    carried = [c for c in reviews.columns if c not in ("pos", "review")]
    if taken := sorted(set(carried) & _ANSWER_COLUMNS):
        raise ValueError(f"columns of the reviews have names that answers use: {', '.join(taken)}")
    check_run(models, template)
    # reviews are dealt to the tasks once for all models, but for few of them, whose models are dealt as well
    if concurrency and reviews.limit(REVIEWS_A_TASK * concurrency).count() == REVIEWS_A_TASK * concurrency:
        asked = fan_out(reviews.repartition(concurrency, "pos", "review"), models)
    elif concurrency:
        asked = fan_out(reviews, models).repartition(concurrency, "model", "pos")
    else:
        asked = fan_out(reviews, models)
    return _priced(_called(_requests(asked, template), call, retries), counters, carried)


def _requests(asked: DataFrame, template: str) -> DataFrame:
    """Reviews with their models as requests; prompts are made last, so that no shuffle carries them."""
    return _with_call_id(with_settings(asked.withColumn("prompt", render_prompt(template, F.col("review")))))


def score_prompt(
    spark, models: Sequence[str], prompt: str, call: Call, retries: dict[str, Retry] | None = None
) -> DataFrame:
    """One fixed prompt through many models; ids of other providers become error rows."""
    if not models:
        raise ValueError("choose at least one model")
    rows = [(m, i, 0, prompt, prompt) for i, m in enumerate(dict.fromkeys(models))]
    requests = spark.createDataFrame(rows, "model STRING, model_ord INT, pos BIGINT, review STRING, prompt STRING")
    supported = F.col("model").startswith("openai:") | ~F.col("model").contains(":")
    refused = F.when(
        ~supported,
        F.concat(F.lit("Unsupported model provider: "), F.substring_index("model", ":", 1)),
    )
    prepared = _with_call_id(with_settings(requests)).withColumn("refusal", refused)
    return _priced(_called(prepared, call, retries))


def _with_call_id(requests: DataFrame) -> DataFrame:
    """The id a provider is called with; the requested id keeps deciding the price."""
    plain = strip_provider(F.col("model"))
    return requests.withColumn(
        "called_model", F.when(F.col("provider") == "openai", resolve_alias(plain)).otherwise(plain)
    ).withColumn("refusal", F.lit(None).cast("string"))


@dataclass
class Bucket:
    """Lets calls pass at a steady rate; up to `burst` may come at once after a pause."""

    per_second: float
    burst: float = 1.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self.held, self.last = self.burst, self.clock()

    def take(self) -> None:
        now = self.clock()
        self.held = min(self.burst, self.held + (now - self.last) * self.per_second) - 1
        self.last = now
        if self.held < 0:
            self.sleep(-self.held / self.per_second)


def score_resumable(
    reviews: DataFrame,
    models: Sequence[str],
    template: str,
    call: Call,
    journal: Journal,
    retries: dict[str, Retry] | None = None,
    counters: Mapping[str, Counter] | None = None,
    concurrency: int = 16,
    rates: Mapping[str, float] | None = None,
    repeat_failures: bool = False,
) -> DataFrame:
    """`score` for long runs: finished calls are recorded, and a run that is started again makes only the others.

    Calls the models at once and returns the answers from the journal, so reading the result again calls nobody. A call is known
    by run, model, position and prompt. A task that is retried goes on after the calls that its earlier attempts recorded.
    `rates` are calls per second and provider over all tasks; each of the `concurrency` tasks keeps its share.
    With `repeat_failures` calls whose answer was an error are made again.
    """
    carried = [c for c in reviews.columns if c not in ("pos", "review")]
    if taken := sorted(set(carried) & (_ANSWER_COLUMNS | {"prompt_md5", "review_md5"})):
        raise ValueError(f"columns of the reviews have names that answers use: {', '.join(taken)}")
    spark = reviews.sparkSession
    check_run(models, template)
    # what is compared with the journal are keys without texts; reviews are joined with what is left of them
    named = reviews.withColumn("review_md5", F.md5("review"))
    keys = render_prompts(named, models, template).withColumn("prompt_md5", F.md5("prompt"))
    call_key, review_key = ["model", "pos", "prompt_md5"], ["pos", "review_md5"]
    keys = keys.select("model", "model_ord", "pos", "review_md5", "prompt_md5").dropDuplicates(call_key)
    known = journal.entries(spark).select(*call_key, "success")
    done = known.where("success") if repeat_failures else known
    left = durable(keys.join(done.drop("success"), call_key, "left_anti"))
    # reviews are dealt to the tasks as they are joined, but for few of them, whose models are dealt as well
    if left.select(*review_key).distinct().limit(REVIEWS_A_TASK * concurrency).count() < REVIEWS_A_TASK * concurrency:
        asked = named.join(left, review_key).repartition(concurrency, "model", "pos")
    else:
        asked = named.repartition(concurrency, *review_key).join(left.repartition(concurrency, *review_key), review_key)
    shares = {provider: per_second / concurrency for provider, per_second in (rates or {}).items()}
    _called(_requests(asked, template), call, retries, journal, shares).write.format("noop").mode("overwrite").save()
    answers = named.join(keys.join(journal.entries(spark), call_key), review_key)
    return _priced(_requests(answers, template), counters, carried)


def _called(
    requests: DataFrame, call: Call, retries: dict[str, Retry] | None, journal: Journal | None = None, rates: Mapping[str, float] | None = None
) -> DataFrame:
    policy = {**DEFAULT_RETRIES, **(retries or {})}
    job = uuid.uuid4().hex

    def guarded(model: str, prompt: str, settings: dict) -> tuple:
        if settings["refusal"]:
            raise ValueError(settings["refusal"])
        return call(model, prompt, settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = journal.writer(job) if journal else None
        buckets = {provider: Bucket(rate) for provider, rate in (rates or {}).items()}

        def answer(row, settings: dict) -> dict:
            def paced(*request) -> tuple:
                if row.provider in buckets:
                    buckets[row.provider].take()
                return guarded(*request)

            key = (row.model, row.pos, row.prompt_md5) if writer else None
            if writer and key in writer.known:
                return {name: writer.known[key][name] for name in _names}
            found = _answer(paced, policy[row.provider], row.called_model, row.prompt, settings)
            if writer:
                writer.add(*key, found)
            return found

        try:
            yield from answered(batches, answer)
        finally:
            if writer:
                writer.close()

    def answered(batches: Iterator[pd.DataFrame], answer: Callable) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for row in batch.itertuples(index=False):
                settings = dict(
                    system_prompt=row.system_prompt,
                    temperature=row.temperature,
                    max_output_tokens=row.max_output_tokens,
                    refusal=row.refusal,
                )
                answers.append(answer(row, settings))
            made = pd.DataFrame(answers, index=batch.index)
            yield pd.concat([batch, made], axis=1) if len(batch) else batch.assign(**{c: [] for c in _names})

    _names = [part.split()[0] for part in ANSWER.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields] + [ANSWER])
    return requests.mapInPandas(run, schema)


def _priced(
    answers: DataFrame, counters: Mapping[str, Counter] | None = None, carried: Sequence[str] = ()
) -> DataFrame:
    def tokens(reported: str, text: str) -> Column:
        uncounted = F.col("success") & (F.col(reported) == 0)
        return F.when(uncounted, count_tokens(F.col(text), F.col("model"), counters)).otherwise(F.col(reported))

    counted = answers.withColumns(
        {
            "prompt_tokens": tokens("reported_prompt_tokens", "prompt"),
            "completion_tokens": tokens("reported_completion_tokens", "response"),
        }
    )
    return with_cost(counted).select(
        *carried, "model", "model_ord", "called_model", "provider", "pos",
        preview(F.col("review")).alias("review_preview"), "review", "prompt", "success", "response",
        "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        "latency", "total_time", "cost",
    )
