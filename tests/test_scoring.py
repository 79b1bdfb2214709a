import os
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle

from replylens.functions.tokens import tokenizer_counter
from replylens.operators import prompts, scoring
from replylens.operators.journal import Journal

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(model, prompt, settings):
    if "boom" in prompt:
        raise RuntimeError("boom")
    if "refuse" in prompt:
        return "Error: refused", 0, 0
    return f"{model}|{settings['temperature']}|{settings['max_output_tokens']}", 0, 3


def no_sleep(_):
    pass


FAST = {p: scoring.Retry(on=r.on, attempts=r.attempts, sleep=no_sleep) for p, r in scoring.DEFAULT_RETRIES.items()}


def reviews(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "pos BIGINT, review STRING")


def test_rows_of_a_run(spark):
    df = scoring.score(reviews(spark, "good food", "boom", "refuse"), ["gpt4o", "claude-3-haiku"], "Rate {review}", answer, FAST)
    rows = {(r.model, r.pos): r for r in df.collect()}
    assert len(rows) == 6
    good = rows["gpt4o", 0]
    assert good.response == "gpt-4o|0.7|2048" and good.called_model == "gpt-4o" and good.success
    assert good.prompt_tokens == pytest.approx(3 * 1.3) and good.completion_tokens == 3
    assert good.total_tokens == good.prompt_tokens + 3
    # priced by the requested id, which only the default row fits
    assert good.cost == pytest.approx(3.9 / 1e6 * 0.5 + 3 / 1e6 * 1.5)
    assert rows["claude-3-haiku", 0].response == "claude-3-haiku|0.1|500"
    failed = rows["gpt4o", 1]
    assert (failed.success, failed.response, failed.prompt_tokens, failed.latency, failed.cost) == (False, "Error: boom", 0, 0, 0)
    refused = rows["gpt4o", 2]
    assert (refused.success, refused.response, refused.total_tokens) == (False, "Error: refused", 0)


class Failing:
    def __init__(self, failures, error):
        self.failures, self.error, self.calls = failures, error, 0

    def __call__(self, model, prompt, settings):
        self.calls += 1
        if self.calls <= self.failures:
            raise self.error
        return "ok", 1, 1


@pytest.mark.parametrize(
    "provider, error, failures, calls, waits",
    [
        ("anthropic", scoring.CallTimeout(), 2, 3, [1.0, 2.0]),
        ("anthropic", scoring.ServerError(), 1, 2, [1.0]),
        ("anthropic", ValueError(), 1, 1, []),
        ("google", ValueError(), 3, 3, [1.0, 2.0]),
        ("openai", scoring.CallTimeout(), 1, 1, []),
    ],
)
def test_retries(provider, error, failures, calls, waits):
    slept = []
    base = scoring.DEFAULT_RETRIES[provider]
    retry = scoring.Retry(base.attempts, base.delay, base.on, slept.append)
    call = Failing(failures, error)
    if failures < calls:
        assert scoring.call_with_retry(call, retry, "m", "p", {})[0] == "ok"
    else:
        with pytest.raises(type(error)):
            scoring.call_with_retry(call, retry, "m", "p", {})
    assert (call.calls, slept) == (calls, waits)


def test_one_prompt_many_models(spark):
    df = scoring.score_prompt(spark, ["gpt-4o", "openai:gpt-4o", "mistral:large"], "hi", answer, FAST)
    rows = {r.model: r for r in df.collect()}
    assert rows["openai:gpt-4o"].response == "gpt-4o|0.7|2048"
    assert rows["mistral:large"].response == "Error: Unsupported model provider: mistral"
    assert not rows["mistral:large"].success and rows["gpt-4o"].success


def test_tokenizers_per_provider(spark):
    def encode(text):
        if "odd" in text:
            raise ValueError
        return list(text)

    counters = {"openai": tokenizer_counter(encode)}
    df = scoring.score(reviews(spark, "a b c", "odd one"), ["gpt-4o", "claude-3-haiku"], "{review}", answer, FAST, counters)
    tokens = {(r.model, r.pos): r.prompt_tokens for r in df.collect()}
    assert tokens["gpt-4o", 0] == 5
    assert [tokens["gpt-4o", 1], tokens["claude-3-haiku", 0]] == pytest.approx([2.6, 3.9])


def test_bad_requests_fail_before_any_job(spark):
    for models, template in (([], "{review}"), (["m"], ""), (["m"], "no placeholder")):
        with pytest.raises(ValueError):
            prompts.check_run(models, template)


def test_fan_out_is_a_map(spark):
    df = prompts.fan_out(reviews(spark, "a", "b"), ["x", "y", "x"])
    assert sorted((r.model, r.model_ord, r.pos) for r in df.collect()) == [("x", 0, 0), ("x", 0, 1), ("y", 1, 0), ("y", 1, 1)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_registry(spark):
    df = spark.createDataFrame([("gpt-4-32k-0613",), ("gemini-9",), ("zzz",)], "model STRING")
    rows = {r.model: r for r in scoring.with_registry(df).collect()}
    assert (rows["gpt-4-32k-0613"].max_tokens, rows["gpt-4-32k-0613"].display_name) == (32768, "GPT-4")
    assert rows["gemini-9"].provider == "google" and rows["zzz"].provider is None


class _Counted:
    """Appends a line per call to a file, and dies at a given call."""

    def __init__(self, path, dies_at=None):
        self.path, self.dies_at = str(path), dies_at

    def __call__(self, model, prompt, settings):
        with open(self.path, "a") as log:
            log.write(f"{model}/{prompt}\n")
        with open(self.path) as log:
            n = len(log.readlines())
        if n == self.dies_at:
            os._exit(1)  # the worker of the task is gone
        if prompt.endswith("bad"):
            raise RuntimeError("refused")
        return f"{n}", 3, 4


def _asked(path):
    return Counter(path.read_text().splitlines())


def test_a_killed_run_goes_on(spark, tmp_path):
    reviews = spark.createDataFrame([(i, f"r{i}") for i in range(12)], "pos BIGINT, review STRING")
    journal, log = Journal(str(tmp_path / "journal"), "run-1"), tmp_path / "calls"
    models = ["gpt-4o", "claude-3-5-haiku"]
    with pytest.raises(Exception, match="(?s)exited|crashed|EOF|Connection"):
        scoring.score_resumable(reviews, models, "{review}", _Counted(log, dies_at=9), journal, concurrency=1)
    answered = journal.entries(spark).count()
    assert answered == 8
    # the call at which the task died never ended, so it alone is made again
    got = scoring.score_resumable(reviews, models, "{review}", _Counted(log), journal, concurrency=3)
    assert got.count() == 24 and got.where("success").count() == 24
    assert sorted(_asked(log).values()) == [1] * 23 + [2]
    # reading again, and starting again, calls nobody; another prompt is another call
    assert got.count() == 24 and scoring.score_resumable(reviews, models, "{review}", _Counted(log), journal).count() == 24
    assert sum(_asked(log).values()) == 25
    scoring.score_resumable(reviews.where("pos = 0"), models[:1], "again {review}", _Counted(log), journal)
    assert sum(_asked(log).values()) == 26


def test_failures_are_repeated_on_demand(spark, tmp_path):
    reviews = spark.createDataFrame([(1, "bad"), (2, "good")], "pos BIGINT, review STRING")
    journal, log = Journal(str(tmp_path / "journal"), "run", roll=1), tmp_path / "calls"
    run = lambda **more: scoring.score_resumable(reviews, ["gpt-4o"], "{review}", _Counted(log), journal, **more)
    assert {(r.pos, r.success) for r in run().collect()} == {(1, False), (2, True)}
    assert run().count() == 2 and _asked(log) == {"gpt-4o/bad": 1, "gpt-4o/good": 1}
    assert run(repeat_failures=True).count() == 2 and _asked(log) == {"gpt-4o/bad": 2, "gpt-4o/good": 1}
    # a line that was cut off counts as a call that was not made
    (part,) = [p for p in (tmp_path / "journal" / "run_id=run").glob("*.json") if "good" in p.read_text() or '"pos": 2' in p.read_text()]
    part.write_text(part.read_text()[:30])
    assert run().where("success").count() == 1 and _asked(log)["gpt-4o/good"] == 2


def test_buckets_keep_a_rate():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    bucket = scoring.Bucket(2.0, burst=3, sleep=sleep, clock=lambda: now[0])
    for _ in range(7):
        bucket.take()
    assert now[0] == pytest.approx(2.0) and len(slept) == 4
    now[0] += 100
    for _ in range(3):
        bucket.take()
    assert len(slept) == 4


def test_prompts_are_made_after_the_shuffle(spark):
    df = scoring.score(reviews(spark, "a", "b"), ["gpt-4o"], "Rate {review}", answer, FAST, concurrency=3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    repartition = plan.index("RepartitionByExpression")
    assert "replace(" in plan[:repartition].lower() and "replace(" not in plan[repartition:].lower()
    assert {r.prompt for r in df.collect()} == {"Rate a", "Rate b"}


def test_many_reviews_are_dealt_once_for_all_models(spark, monkeypatch):
    monkeypatch.setattr(scoring, "REVIEWS_A_TASK", 1, raising=False)
    df = scoring.score(reviews(spark, "a", "b", "c", "d"), ["gpt-4o", "gpt4o"], "Rate {review}", answer, FAST, concurrency=3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    assert Counter((r.model, r.prompt) for r in df.collect()) == Counter((m, f"Rate {t}") for m in ("gpt-4o", "gpt4o") for t in "abcd")


def test_batches_for_python_are_bounded_in_bytes(spark):
    longest = spark.range(400, numPartitions=1).selectExpr("repeat('x', 100000) text")
    sizes = longest.mapInArrow(lambda batches: (b.__class__.from_arrays([[b.nbytes]], names=["n"]) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) < 8 << 20


@pytest.mark.parametrize("a_task", [1, 32])
def test_a_resumed_run_joins_keys_without_texts(spark, tmp_path, monkeypatch, a_task):
    monkeypatch.setattr(scoring, "REVIEWS_A_TASK", a_task, raising=False)
    rows = [(0, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "")]
    asked = spark.createDataFrame(rows, "pos BIGINT, review STRING")
    journal, log = Journal(str(tmp_path / "journal"), "run"), tmp_path / "calls"
    models = ["gpt-4o", "claude-3-5-haiku"]
    scoring.score_resumable(asked.where("pos = 0"), models, "Rate {review}", _Counted(log), journal, concurrency=2)
    got = scoring.score_resumable(asked, models, "Rate {review}", _Counted(log), journal, concurrency=2)
    # equal reviews at one position have an answer each
    assert Counter((r.model, r.pos, r.review, r.prompt) for r in got.collect()) == Counter((m, p, t, f"Rate {t}") for m in models for p, t in rows)
    assert _asked(log)["gpt-4o/Rate a"] == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(model" in line]
    assert shuffled and "prompt_md5" in shuffled[0]
    assert plan.index("Rate {review}") < plan.index("Exchange")
