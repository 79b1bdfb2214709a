from datetime import datetime
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from replylens.fixed_values import RANKED_METRICS
from replylens.operators import ranking, stats
from replylens.plans import report
from replylens.plans.evaluate import evaluate
from replylens.streaming import live_stats

SCHEMA = (
    "model STRING, model_ord INT, pos BIGINT, success BOOLEAN, response STRING, prompt_tokens DOUBLE, "
    "completion_tokens DOUBLE, latency DOUBLE, review STRING, prompt STRING"
)
ROWS = [
    ("gpt-4o", 0, 0, True, '{"service": 1, "food": 2}', 100.0, 50.0, 1.0, "r0", "p0"),
    ("gpt-4o", 0, 1, True, 'ok {"service": 1}', 200.0, 50.0, 3.0, "r1", "p1"),
    ("gpt-4o", 0, 2, False, "Error: down", 0.0, 0.0, 0.0, "r2", "p2"),
    ("o1", 1, 0, False, "Error: down", 0.0, 0.0, 0.0, "r0", "p0"),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_model(df):
    return {r.model: r for r in df.collect()}


def test_run_stats(log):
    rows = by_model(stats.run_stats(log))
    assert (rows["gpt-4o"].successful, rows["gpt-4o"].errors, rows["gpt-4o"].total_tokens) == (2, 1, 400)
    assert (rows["gpt-4o"].average_latency, rows["gpt-4o"].avg_tokens) == (2.0, 200.0)
    assert (rows["o1"].successful, rows["o1"].avg_tokens, rows["o1"].average_latency) == (0, 0, 0)


def test_failed_calls_count_unless_told_otherwise(log):
    recorded = by_model(evaluate(log, expected_keys=["service", "food"]))["gpt-4o"]
    assert recorded.success_rate == 1.0 and recorded.avg_latency == pytest.approx(4 / 3)
    assert recorded.json_validity == pytest.approx(2 / 3)
    texts = [r[4] for r in ROWS[:3]]
    pairs = [SequenceMatcher(None, a, b).ratio() for a, b in combinations(texts, 2)]
    assert recorded.format_consistency == pytest.approx(sum(pairs) / 3)
    assert recorded.structural_accuracy == pytest.approx(0.75)
    assert recorded.json_structure_consistency == 0.5
    strict = by_model(evaluate(log, policy="prefix"))
    assert strict["gpt-4o"].success_rate == pytest.approx(2 / 3) and strict["gpt-4o"].avg_latency == 2.0
    assert strict["o1"].success_rate == 0 and strict["o1"].json_validity == 0


def test_error_column_is_respected(spark):
    df = spark.createDataFrame([("m", 0, "x", "bad"), ("m", 0, "x", None)], "model STRING, model_ord INT, response STRING, error STRING")
    assert df.filter(stats.usable(df)).count() == 1


def test_models_without_rows_score_zero(spark, log):
    models = spark.createDataFrame([("gpt-4o", 0), ("silent", 1)], "model STRING, model_ord INT")
    rows = by_model(stats.with_eval_defaults(models, evaluate(log)))
    assert rows["silent"].success_rate == 0 and rows["gpt-4o"].success_rate == 1


def frame(spark, values):
    rows = [(f"m{i}", i, *v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "model STRING, model_ord INT, " + ", ".join(f"{m} DOUBLE" for m in RANKED_METRICS))


def test_ties_keep_model_order(spark):
    ranked = ranking.rank_models(frame(spark, [[0.5] * 7, [0.5 + 1e-15] * 7]))
    assert {r.model for r in ranked.filter("rank = 1").collect()} == {"m0"}
    assert {r.model: r.score for r in ranking.borda(ranked).collect()} == {"m0": 14, "m1": 7}


def test_missing_values_rank_last_or_count_as_zero(spark):
    ranked = ranking.rank_models(frame(spark, [[None] * 7, [-1.0, 9.0, 9.0, 1.0, 1.0, 1.0, 1.0]])).collect()
    first = {r.metric: r.model for r in ranked if r.rank == 1}
    assert first["avg_cost"] == "m1" and first["success_rate"] == "m0" and first["json_validity"] == "m1"


def python_ranking(values):
    models = {f"m{i}": dict(zip(RANKED_METRICS, v)) for i, v in enumerate(values)}
    ranks = {
        m: sorted(models, key=lambda x: models[x][m], reverse=m not in ("avg_latency", "avg_cost")) for m in RANKED_METRICS
    }
    scores = {x: sum(len(models) - ranks[m].index(x) for m in RANKED_METRICS) for x in models}
    return ranks | {"overall": sorted(scores, key=scores.get, reverse=True)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([0.0, 0.25, 0.5, 1.0]), min_size=7, max_size=7), min_size=1, max_size=6))
def test_ranking_against_python(spark, values):
    got = {}
    for r in ranking.full_ranking(frame(spark, values)).orderBy("rank").collect():
        got.setdefault(r.metric, []).append(r.model)
    assert got == python_ranking(values)


def test_runs_are_evaluated_side_by_side(spark, log):
    both = log.selectExpr("'one' run_id", "*").unionByName(
        log.filter("model = 'o1'").selectExpr("'two' run_id", "*")
    )
    evaluation = evaluate(both, keys=("run_id", "model"))
    ranked = ranking.full_ranking(evaluation, run=("run_id",))
    rows = {r.run_id: r for r in ranking.recommendations(ranked, run=("run_id",)).collect()}
    assert rows["one"].best_overall == "gpt-4o" and rows["two"].top_models == ["o1"]


def test_recommendations(spark, log):
    ranked = ranking.full_ranking(evaluate(log))
    row = ranking.recommendations(ranked).first()
    assert (row.best_overall, row.top_models) == ("gpt-4o", ["gpt-4o", "o1"])
    assert (row.best_value, row.fastest, row.most_accurate) == ("o1", "o1", "gpt-4o")
    empty = ranking.recommendations(ranked.limit(0)).first()
    assert (empty.best_overall, empty.top_models, empty.fastest) == (None, [], None)


def test_report(spark, log):
    from replylens.functions.pricing import with_cost

    responses = with_cost(log).withColumn("total_tokens", log.prompt_tokens + log.completion_tokens)
    samples = report.sample_response(responses)
    assert {(r.model, r.pos) for r in samples.collect()} == {("gpt-4o", 0), ("o1", 0)}
    top = report.top_responses(responses, 2).collect()
    assert {(r.model, r.review_number, r.more) for r in top} == {("gpt-4o", 1, 1), ("gpt-4o", 2, 1), ("o1", 1, 0)}
    evaluation = evaluate(log)
    ranked = ranking.full_ranking(evaluation)
    run = stats.run_stats(log)
    doc = report.report_document(run, evaluation, ranked, samples, "a.csv", datetime(2025, 1, 2, 3, 4, 5)).collect()
    assert len(doc) == 1 and doc[0].report_name == "report_20250102_030405"
    assert doc[0].rankings["overall"] == ["gpt-4o", "o1"]
    assert doc[0].models["gpt-4o"].avg_latency_text == "1.33 seconds"
    assert doc[0].sample_responses["o1"].response == "Error: down"
    assert len(doc[0].charts) == 12
    assert report.overview(run, ranked, "a.csv").first().total_reviews == 4


def test_report_without_ranking_still_has_recommendations(spark, log):
    evaluation = evaluate(log)
    empty = ranking.full_ranking(evaluation).limit(0)
    row = report.overview(stats.run_stats(log), empty, "a.csv").collect()
    assert len(row) == 1 and row[0].best_overall is None


def test_stream_matches_batch(spark, log, tmp_path):
    path, out = str(tmp_path / "responses"), str(tmp_path / "stats")
    (tmp_path / "responses").mkdir()
    stream = live_stats.running_stats(live_stats.read_responses(spark, path, log.schema))
    for model in ("gpt-4o", "o1"):  # files arrive one after the other
        log.filter(log.model == model).write.mode("append").parquet(path)
        live_stats.write_stats(stream, out, str(tmp_path / "state")).awaitTermination()
    key = lambda r: r.model
    assert sorted(spark.read.parquet(out).collect(), key=key) == sorted(stats.run_stats(log).collect(), key=key)


def test_metrics_follow_every_file_of_a_run(spark, tmp_path):
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    replies = ['{"a": 1}', '{"a": 1, "b": 2}', '{"b": 0}', "text", "[1]", '{"c": {}}', "Error: x"]
    rows = [(f"m{i % 2}", i % 2, i, i % 7 != 6, replies[i % 7], float(i), float(2 * i), 0.5) for i in range(60)]
    columns = "model STRING, model_ord INT, pos BIGINT, success BOOLEAN, response STRING, prompt_tokens DOUBLE, completion_tokens DOUBLE, latency DOUBLE"
    done = []
    for part in (rows[:13], rows[13:40], rows[40:]):
        log = spark.createDataFrame(part, columns).coalesce(1)
        log.write.mode("append").parquet(path)
        done += part
        stream = live_stats.running_evaluation(live_stats.read_responses(spark, path, log.schema, 1), expected_keys=["a", "z"])
        live_stats.write_evaluation(stream, out, state).awaitTermination()
        got = {r.model: r.asDict() for r in live_stats.latest_evaluation(spark, out).collect()}
        want = evaluate(spark.createDataFrame(done, columns), expected_keys=["a", "z"]).drop("format_consistency")
        assert got == {r.model: pytest.approx(r.asDict()) for r in want.collect()}
