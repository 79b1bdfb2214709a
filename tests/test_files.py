from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from replylens.operators import cleaning
from replylens.sources import columns, readers, sinks


def texts(df):
    return [r.review for r in df.orderBy("source", "pos").collect()]


def write(path, content):
    path.write_text(content, encoding="utf-8", newline="")
    return str(path)


def test_dirty_values(spark):
    values = [None, "", "   ", "N/A", "NaN", "None", "Review: great", "  ok  "]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "source STRING, pos BIGINT, review STRING")
    assert texts(cleaning.clean_reviews(cleaning.nullify_na(df, ["review"]))) == ["ok"]
    assert texts(cleaning.clean_reviews(df, na_tokens=("N/A", "NaN", "None"))) == ["ok"]
    assert texts(cleaning.clean_reviews(df, None, ("N/A",))) == ["NaN", "None", "Review: great", "ok"]


def test_csv_with_known_column(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'review_id,customer_name,date,rating,review_text\n'
        '1,Ann,2024-01-01,5,"Good, really"\n2,Bo,2024-01-02,,"Said ""wow""\nagain"\n3,Cy,2024-01-03,1,N/A\n',
    )
    assert texts(readers.read_csv_reviews(spark, path)) == ["Good, really", 'Said "wow"\nagain']
    assert texts(readers.read_reviews(spark, path)) == ["Good, really", 'Said "wow"\nagain']
    assert texts(readers.read_reviews(spark, path, "customer_name")) == ["Ann", "Bo", "Cy"]
    assert texts(readers.read_reviews(spark, path, "1")) == ["Ann", "Bo", "Cy"]
    assert texts(readers.read_reviews(spark, path, "-1")) == []
    assert texts(readers.read_reviews(spark, path, "nope")) == []


def test_file_columns_named_like_ours(spark, tmp_path):
    path = write(tmp_path / "a.csv", "source,pos,feedback\nx,9,fine\ny,8,bad\n")
    assert texts(readers.read_csv_reviews(spark, path)) == ["fine", "bad"]


def test_text_column_detection():
    assert columns.detect_text_column(["id", "Review_Text", "comment"]) == "Review_Text"
    assert columns.detect_text_column(["id", "stars", "body"]) == "body"
    assert columns.detect_text_column(["review_id", "body"]) == "review_id"
    assert columns.only_column(["a"]) == "a" and columns.only_column(["a", "b"]) is None
    assert columns.pick_column(["a", "b"], "1") == "b"
    assert columns.pick_column(["a", "b"], "-1") is None and columns.pick_column(["a"], "1") is None


def test_quotes_go_only_if_the_first_review_has_them(spark):
    rows = [("a", 1, '"x"'), ("a", 2, '""y'), ("b", 1, "x"), ("b", 2, '"y"'), ("c", 5, '"')]
    df = spark.createDataFrame(rows, "source STRING, pos BIGINT, review STRING")
    assert texts(cleaning.strip_quotes_if_first_quoted(df)) == ["x", "y", "x", '"y"', ""]


def test_headerless(spark, tmp_path):
    path = write(tmp_path / "a.csv", "1,good\n2,bad\n")
    df = readers.read_csv(spark, path, header=False)
    assert readers.data_columns(df) == ["0", "1"]
    assert texts(readers.read_csv_headerless(spark, path)) == ["good", "bad"]
    single = write(tmp_path / "b.csv", "one\nReview 2\ntwo\n")
    assert texts(readers.read_csv_headerless(spark, single)) == ["one", "two"]


def test_sheet_rules(spark):
    rows = [("f", 0, "Reviews"), ("f", 1, "reviewed it"), ("f", 2, " REVIEWS "), ("f", 3, "N/A")]
    sheet = spark.createDataFrame(rows, "_file STRING, _pos BIGINT, Unnamed STRING")
    assert texts(readers.read_sheet_reviews(sheet)) == ["reviewed it"]
    hinted = sheet.withColumnRenamed("Unnamed", "reviews")
    assert texts(readers.read_sheet_reviews(hinted)) == ["reviewed it"]


@pytest.mark.parametrize(
    "content",
    ["a\nb\n", "a\nb\n\nc", "\na\nb", "\n\na\nb", "a\nb\n\n", "a\n\n\nb\nc", "  a \n\n \n\n\n b", "", "\n", "Review 1\nx"],
)
def test_text_layouts(spark, tmp_path, content):
    path = write(tmp_path / "t.txt", content)
    want = [p.strip() for p in content.split("\n\n" if "\n\n" in content else "\n") if p.strip()]
    assert texts(readers.read_text_reviews(spark, path)) == want
    assert texts(readers.read_text_reviews(spark, path, whole_files=False)) == want


def test_text_files_decide_one_by_one(spark, tmp_path):
    write(tmp_path / "a.txt", "a\r\nb\r\n\r\nc")
    write(tmp_path / "b.txt", "d\r\ne")
    assert texts(readers.read_text_reviews(spark, str(tmp_path))) == ["a\nb", "c", "d", "e"]


def test_alternating_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Review 1\nnice, very\nReview 2\n\npoor\n")
    assert texts(readers.read_lines(spark, path)) == ["nice, very", "poor"]


def test_ragged_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'x,y,first\nx,"sec,ond"\nthird\nx,Review 4\n')
    assert texts(readers.read_ragged_csv(spark, path)) == ["first", "sec,ond", "third"]
    narrow = write(tmp_path / "b.csv", "one\nreview,two\n")
    assert texts(readers.read_ragged_csv(spark, narrow)) == ["one", "two"]
    long = write(tmp_path / "c.csv", "x,1\n2,\n3,x,\n" + "y," * 99 + "hundredth\n")
    assert texts(readers.read_ragged_csv(spark, long)) == ["1", "hundredth"]
    assert texts(readers.read_ragged_csv(spark, long, multi_line=False)) == ["1", "hundredth"]


def test_fallback_chain(spark, tmp_path):
    # only a header: the first reader finds nothing, the second reads the line itself
    path = write(tmp_path / "a.csv", "wonderful place\n")
    assert texts(readers.csv_with_fallbacks(spark, path)) == ["wonderful place"]


def test_each_file_of_a_folder_falls_back_for_itself(spark, tmp_path):
    write(tmp_path / "a.csv", "id,feedback\n1,fine\n")
    write(tmp_path / "b.csv", "0,great food\n")
    write(tmp_path / "c.csv", "feedback,id\nlovely,9\n")
    assert texts(readers.csv_with_fallbacks(spark, str(tmp_path))) == ["fine", "great food", "lovely"]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", "id,feedback\n1,fine\n")
    write(tmp_path / "b.csv", "feedback,id\nlovely,9\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv_reviews(spark, str(tmp_path)).collect()


def test_sheet_without_header(spark):
    sheet = spark.createDataFrame([("f", 0, "1", "good"), ("f", 1, "2", " N/A ")], "_file STRING, _pos BIGINT, `0` STRING, `1` STRING")
    assert "good" in texts(readers.read_sheet_reviews(sheet, header=False))


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        readers.read_reviews(spark, "a.pdf")
    assert readers.is_allowed("x/Y.CSV") and not readers.is_allowed("noext")


def test_samples(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,\n2,y\n3,z\n4,w\n")
    got = columns.sample_values(readers.read_csv(spark, path)).orderBy("column_ord", "sample_ord").collect()
    assert [(r.column_name, r.value) for r in got] == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "nan"), ("b", "y"), ("b", "z")]


def test_inspection(spark, tmp_path):
    csv = write(tmp_path / "a.csv", "a,b\n1,\n2,y\n3,z\n4,w\n")
    seen = readers.inspect_file(spark, csv)
    assert (seen.columns, seen.sample, seen.file_type) == (["a", "b"], {"a": ["1", "2", "3"], "b": ["nan", "y", "z"]}, "csv")
    text = write(tmp_path / "a.txt", "\n one\n\ntwo\nthree\nfour\n")
    assert readers.inspect_file(spark, text).sample == {"text": ["one", "two", "three"]}
    assert readers.inspect_file(spark, "a.pdf").error and readers.inspect_file(spark, str(tmp_path / "no.csv")).error


def test_staging_replaces_one_run_only(spark, tmp_path):
    path, at = str(tmp_path / "staged"), datetime(2025, 1, 1)

    def stage(run, *values):
        df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "source STRING, pos BIGINT, review STRING")
        sinks.stage_reviews(df, path, run, at, "a.csv", "review")

    stage("one", "x", "y")
    stage("two", "z")
    stage("one", "w")
    assert texts(readers.read_staged(spark, path, "one")) == ["w"]
    staged = readers.read_staged(spark, path, "two")
    assert texts(staged) == ["z"]
    assert "PartitionFilters: [isnotnull(run_id" in staged._jdf.queryExecution().executedPlan().toString()


def test_missing_report(spark, tmp_path):
    path = str(tmp_path / "reports")
    document = spark.range(1).select(F.lit("r1").alias("report_name"), F.create_map(F.lit("m"), F.struct(F.lit(1).alias("n"))).alias("models"))
    for _ in range(2):  # a name written again replaces the report
        sinks.write_report(document, path)
    stored = readers.read_report(spark, path, "r1")
    assert stored.count() == 1 and stored.schema["models"].dataType.simpleString() == "map<string,struct<n:int>>"
    sinks.export_report(document, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().report_name == "r1"
    with pytest.raises(FileNotFoundError):
        readers.read_report(spark, path, "r2")


def test_writers_at_the_same_time_leave_whole_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    with pytest.raises(FileNotFoundError):
        readers.read_report(spark, path, "r")
    documents = [spark.range(40).selectExpr("'r' report_name", f"{w} writer", "id line").repartition(4) for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda d: sinks.write_report(d, path), documents))
    rows = readers.read_report(spark, path, "r").collect()
    assert len(rows) == 40 and {r.line for r in rows} == set(range(40))
    assert {r.writer for r in rows} == {versions.index(max(versions))}
    # a write that did not end is not seen
    documents[0].write.partitionBy("report_name").parquet(f"{path}/versions/9")
    assert readers.read_report(spark, path, "r").count() == 40
