"""The files that the queries over readers write: how many there are, and what a task without rows leaves."""

from pathlib import Path

import pytest

from checks.compare import connect, difference
from checks.queries import QUERIES
from replylens.sources import readers

OF_KIND = 30


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of which the first task reads only such as belong into no file with a header."""
    folder = tmp_path_factory.mktemp("chain")
    made = spark.range(40 * OF_KIND).selectExpr(
        "id AS doc_id", "'en' AS lang", "'web' AS source", "concat('It, \"was\" ', id, ',\"', '\\n', ' fine') AS text", "20L AS n_chars", "id % 40 = 2 AS apart"
    )
    # the file that is larger is read first
    made.where("apart").selectExpr("* except (text, apart)", "concat(text, repeat('x', 9000), uuid()) AS text").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    made.where("not apart").drop("apart").coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    settings = {"spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "1m"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield str(folder)
    for key, value in before.items():
        spark.conf.set(key, value)


def test_files_are_far_fewer_than_documents(spark, sf_dir, monkeypatch):
    seen = []
    real = readers.csv_with_fallbacks
    monkeypatch.setattr(readers, "csv_with_fallbacks", lambda spark, paths: seen.extend(paths) or real(spark, paths))
    assert QUERIES["csv_fallback_chain"](spark, sf_dir).count() > 0
    files = [f for p in seen for f in Path(p.removeprefix("file:")).glob("part-*") if f.stat().st_size]
    assert len(seen) == 7 <= len(files) <= 14


@pytest.mark.parametrize("name", ["csv_fallback_chain", "dispatch_reviews"])
def test_tasks_without_rows(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), sf_dir, name) == ""
