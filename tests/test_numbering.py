import re

import pytest
from pyspark.sql import functions as F

from replylens.operators import browse, numbering


@pytest.fixture(params=["small", "large"])
def groups(request, monkeypatch):
    """Groups as those that one task sorts, and as those that no task should."""
    monkeypatch.setattr(numbering, "GROUP_ROWS", 10**6 if request.param == "small" else 10)


def test_numbers_follow_positions_of_any_density(spark, groups):
    rows = [("hot", (i * 37) % 1000) for i in range(300)] + [("cold", -5), ("cold", 10**15)]
    df = spark.createDataFrame(rows, "source STRING, pos BIGINT").repartition(5)
    got = numbering.number_rows(df, ["source"], total="n").collect()
    for source in ("hot", "cold"):
        numbered = sorted((r.review_number, r.pos) for r in got if r.source == source)
        positions = sorted(p for s, p in rows if s == source)
        assert numbered == list(enumerate(positions, 1))
        assert {r.n for r in got if r.source == source} == {len(positions)}


def test_limit_keeps_the_first_rows(spark):
    df = spark.range(1000).selectExpr("case when id % 3 = 0 then 'a' else 'b' end source", "id pos", "'t' review")
    kept = browse.limit_reviews(df).groupBy("source").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()
    assert {(r.source, r.n) for r in kept} == {("a", 100), ("b", 100)}
    assert {r.last for r in kept} == {297, 149}
    assert browse.limit_reviews(df, 5, ()).count() == 5


@pytest.mark.parametrize("n", [5, 5000])
def test_limit_prunes_before_a_shuffle_of_parts(spark, n):
    df = spark.range(1000000).selectExpr("cast(id % 3 as string) source", "id pos")
    plan = numbering.pruned(df, ["source"], n)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert re.findall(r"hashpartitioning\(source#\d+, _part#\d+", plan) and plan.count("hashpartitioning") == 1


def test_large_limit_on_sparse_positions(spark, groups):
    df = spark.range(20000).selectExpr("if(id % 4 = 0, 'a', 'b') source", "id * 56294995342131 pos")
    kept = numbering.first_rows(df, ["source"], 3000, number="n")
    got = {r.source: (r.c, r.last, r.top) for r in kept.groupBy("source").agg(
        F.count("*").alias("c"), F.max("pos").alias("last"), F.max("n").alias("top")).collect()}
    assert got == {"a": (3000, 2999 * 4 * 56294995342131, 3000), "b": (3000, 3999 * 56294995342131, 3000)}


def test_positions_of_a_run(spark, groups):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("a", 0), ("b", 1)], "source STRING, pos INT")
    got = numbering.run_positions(df).collect()
    assert {(r.source, r.source_pos, r.pos) for r in got} == {("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("b", 1, 3)}


@pytest.mark.parametrize("repeated", [False, True])
def test_large_groups_keep_texts_out_of_the_sort(spark, monkeypatch, repeated):
    monkeypatch.setattr(numbering, "GROUP_ROWS", 10)
    stored, plain = [], numbering.durable
    monkeypatch.setattr(numbering, "durable", lambda df: stored.append(df.columns) or plain(df))
    df = spark.range(300).selectExpr("if(id % 3 = 0, 'b', 'a') source", f"if(id = 7, null, id div {2 if repeated else 1}) pos", "repeat('t', id) review")
    rows = numbering.number_rows(df, ["source"], total="n").collect()
    assert len(rows) == 300 and {r.n for r in rows} == {100, 200}
    for source in ("b", "a"):
        mine = sorted((r for r in rows if r.source == source), key=lambda r: r.review_number)
        assert [r.review_number for r in mine] == list(range(1, len(mine) + 1))
        placed = [-1 if r.pos is None else r.pos for r in mine]
        assert placed == sorted(placed)
    assert any("review" in columns for columns in stored) == repeated


@pytest.mark.parametrize("keys", [[], ["source"]])
def test_texts_of_a_middling_group_stay_out_of_its_sort(spark, monkeypatch, keys):
    monkeypatch.setattr(numbering, "WIDE_ROWS", 10, raising=False)
    df = spark.range(300).selectExpr("if(id % 3 = 0, 'b', 'a') source", "300 - id pos", "repeat('t', int(id)) review")
    for table, sorted_whole in ((df, False), (df.select(*keys, "pos"), True)):
        numbered = numbering.number_rows(table, keys)
        assert ("row_number" in numbered._jdf.queryExecution().executedPlan().toString()) == sorted_whole
        for source in ("b", "a") if keys else (None,):
            mine = sorted((r for r in numbered.collect() if source is None or r.source == source), key=lambda r: r.review_number)
            assert [r.review_number for r in mine] == list(range(1, len(mine) + 1))
            assert [r.pos for r in mine] == sorted(r.pos for r in mine) and (sorted_whole or all(len(r.review) == 300 - r.pos for r in mine))


def test_pages(spark, groups):
    df = spark.range(23).selectExpr("'a' source", "id pos", "'t' review")
    pages = browse.paginate(df)
    last = browse.page(pages, 3).orderBy("pos").collect()
    assert [r.review_number for r in last] == [21, 22, 23]
    assert {(r.page_first, r.page_last) for r in last} == {(21, 23)}


def test_search(spark):
    df = spark.createDataFrame([("Good Food",), ("bad",)], "review STRING")
    assert browse.search_reviews(df, "FOOD").count() == 1
