import pytest
from pyspark.sql import functions as F

from replylens.functions.pricing import price_of, with_cost
from replylens.operators import prices

RESOLVED = [
    ("gpt-4o", "gpt-4o", "exact"),
    ("gpt-4-turbo", "gpt-4", "prefix"),
    ("gpt-4o-2024-11-20", "gpt-4", "prefix"),
    ("gpt-4.1-mini-2025-04-14", "gpt-4", "prefix"),
    ("gpt-3.5-turbo-0613", "gpt-3.5-turbo", "prefix"),
    ("claude-3-7-sonnet-20250219", "claude-3-7-sonnet", "prefix"),
    ("claude-3-5-haiku-20241022", "claude-3-7-sonnet", "prefix"),
    ("claude-3-opus-20240229", "claude-3-7-sonnet", "prefix"),
    ("claude-3-5-sonnet-20240620", "claude-3-5-sonnet-20240620", "exact"),
    ("claude-2.1-x", "claude-2.1", "prefix"),
    ("claude-4-opus", "gpt-3.5-turbo", "default"),
    ("gemini-2.5-flash-001", "gemini-2.5-pro", "prefix"),
    ("gemini-2.0-flash-001", "gemini-2.0-flash", "prefix"),
    ("o1", "gpt-3.5-turbo", "default"),
    ("gpt", "gpt-3.5-turbo", "prefix"),
]

COSTS = [
    ("gpt-4o", 1500, 500, 0.0175),
    ("openai:gpt-4o", 1500, 500, 0.0175),
    ("gpt-3.5-turbo", 1000, 500, 0.00125),
    ("gemini-2.5-pro", 200000, 0, 1.4),
    ("gemini-2.5-pro", 300000, 10, 1.60021),
    ("gemini-2.5-pro", 10, 300000, 4.80007),
]


def test_price_resolution(spark):
    df = spark.createDataFrame(RESOLVED, "model STRING, key STRING, how STRING").withColumn("p", price_of(F.col("model")))
    wrong = df.filter((F.col("p.key") != F.col("key")) | (F.col("p.price_source") != F.col("how")))
    assert wrong.collect() == []


def test_costs(spark):
    df = spark.createDataFrame(COSTS, "model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, want DOUBLE")
    for row in with_cost(df).collect():
        assert row.cost == pytest.approx(row.want, abs=1e-12)


def test_tiered_cost_is_monotone_and_continuous(spark):
    tokens = [(t,) for t in (0, 1, 199_999, 200_000, 200_001, 400_000)]
    df = spark.createDataFrame(tokens, "prompt_tokens BIGINT").withColumns(
        {"model": F.lit("gemini-2.5-pro"), "completion_tokens": F.lit(0)}
    )
    costs = [r.cost for r in with_cost(df).orderBy("prompt_tokens").collect()]
    assert costs == sorted(costs)
    assert costs[4] - costs[3] == pytest.approx(2e-6)
    assert costs[3] - costs[2] == pytest.approx(7e-6)


def test_own_price_list(spark):
    prices = [("gpt-3.5-turbo", 1.0, 1.0, None, None, None), ("it's-mine", 1000.0, 0.0, 10, 1.0, 1.0)]
    df = spark.createDataFrame([("it's-mine", 20, 0)], "model STRING, prompt_tokens INT, completion_tokens INT")
    assert with_cost(df, prices).first().cost == pytest.approx(0.01001)


def test_lookup_needs_no_shuffle(spark):
    df = spark.range(10).select(F.lit("o1").alias("model"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))
    plan = with_cost(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "from_json" not in plan


def test_prices_from_a_table(spark):
    df = spark.createDataFrame([*RESOLVED, ("openai:gpt-4o", "gpt-4o", "exact"), (None, "gpt-3.5-turbo", "default")], "model STRING, want STRING, how STRING")
    got = prices.with_price_from(df, prices.price_table(spark)).collect()
    assert len(got) == len(RESOLVED) + 2
    assert [(r.model, r.price.key, r.price.price_source) for r in got if (r.price.key, r.price.price_source) != (r.want, r.how)] == []
    costs = spark.createDataFrame(COSTS, "model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, want DOUBLE")
    for row in prices.with_cost_from(costs, prices.price_table(spark)).collect():
        assert row.cost == pytest.approx(row.want, abs=1e-12)


def test_versions_of_a_price_list(spark):
    table = prices.price_table(spark)
    both = table.withColumn("version", F.lit(1)).unionByName(
        table.where("key <> 'gpt-4'").withColumns({"version": F.lit(2), "input": F.col("input") * 2})
    )
    log = spark.createDataFrame([("gpt-4-turbo", 1), ("gpt-4-turbo", 2), ("zzz", 2), ("zzz", 3)], "model STRING, version INT")
    got = {(r.model, r.version): r.price and (r.price.key, r.price.input) for r in prices.with_price_from(log, both, ["version"]).collect()}
    assert got == {("gpt-4-turbo", 1): ("gpt-4", 30.0), ("gpt-4-turbo", 2): ("gpt-4-0613", 60.0), ("zzz", 2): ("gpt-3.5-turbo", 1.0), ("zzz", 3): None}


def test_large_price_tables_need_no_nested_loop(spark):
    n = 100_000
    table = spark.range(n).selectExpr(
        "cast(id as int) ord", "concat('m', id) key", "1D input", "1D output", "cast(null as bigint) tier_threshold", "0D tier2_input", "0D tier2_output"
    )
    log = spark.range(0, n, 97).selectExpr("if(id % 2 = 0, concat('m', id), concat('m', id, 'x-1-2')) model", "id")
    priced = prices.with_price_from(log, table)
    plan = priced._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.model: (r.price.key, r.price.price_source) if r.price else None for r in priced.collect()}
    for model, found in got.items():
        digits = model[1:].split("x")[0]
        if "x" in model:
            # the first key that starts the id, or starts with its first two parts, which none does
            assert found == (min((f"m{digits[:i]}" for i in range(1, len(digits) + 1)), key=lambda k: int(k[1:])), "prefix")
        else:
            assert found == (model, "exact")
