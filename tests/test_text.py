import random

from pyspark.sql import functions as F

from replylens.functions import naming
from replylens.functions import text as tx


def column(spark, values, kind, *exprs):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}").select("x", *exprs).collect()


def test_blanks_like_python(spark):
    values = [chr(c) + "a" + chr(c) + "b" + chr(c) for c in range(1, 0x3100)] + ["", "  ", "a"]
    for row in column(spark, values, "STRING", tx.strip_blank(F.col("x")).alias("s"), tx.word_count(F.col("x")).alias("n")):
        assert (row.s, row.n) == (row.x.strip(), len(row.x.split()))


def test_fixed_decimals_like_python(spark):
    chosen = random.Random(7)
    values = [0.125, 2.675, 1.005, 0.0, 5e-5, 5e-7, 0.005, 1.5, 1e-7, 1234567.125]
    values += [chosen.random() * 10 ** chosen.randint(-8, 4) for _ in range(2000)]
    values += [chosen.randint(0, 100_000) / 8e4 for _ in range(2000)]
    exprs = [tx.fixed_decimals(F.col("x"), d).alias(f"d{d}") for d in (2, 4, 6, 8)]
    for row in column(spark, values, "DOUBLE", *exprs):
        assert [row[f"d{d}"] for d in (2, 4, 6, 8)] == [f"{row.x:.{d}f}" for d in (2, 4, 6, 8)]


def test_cost_texts(spark):
    want = {0.0: "$0.0001", 0.00005: "$0.000050", 0.005: "$0.0050", 1.5: "$1.500000", None: "$0.0001"}
    for row in column(spark, list(want), "DOUBLE", tx.format_cost(F.col("x")).alias("c")):
        assert row.c == want[row.x]
    assert column(spark, [1.5], "DOUBLE", tx.format_cost(F.col("x"), 2).alias("c"))[0].c == "$1.50"
    assert column(spark, ["abc"], "STRING", tx.format_cost(F.col("x")).alias("c"))[0].c == "$0.0001"
    assert column(spark, [5e-7], "DOUBLE", tx.format_response_cost(F.col("x")).alias("c"))[0].c == "$0.00000050"


def test_title_case_like_python(spark):
    values = ["GPT-4o mini", "o1", "été-ÀB c3d", "", "a.b_c"]
    for row in column(spark, values, "STRING", tx.title_case(F.col("x")).alias("t")):
        assert row.t == row.x.title()


def test_display_names(spark):
    want = {
        "gpt-4o": "Gpt-4O",
        "claude-3-7-sonnet-20250219": "Claude 3 7 Sonnet",
        "claude-2.1": "Claude 2.1",
        "gemini-2.0-flash-lite": "Gemini 2.0 Flash Lite",
    }
    for row in column(spark, list(want), "STRING", tx.display_name(F.col("x")).alias("n")):
        assert row.n == want[row.x]


def test_aliases(spark):
    want = {
        "gpt-4-0613": "gpt-4-0613", "gpt4": "gpt-4-turbo", "gpt-4-foo": "gpt-4-turbo", "gpt4o": "gpt-4o",
        "gpt-3.5-foo": "gpt-3.5-turbo", "zzz": "gpt-4-turbo", "gpt-4": "gpt-4",
    }
    for row in column(spark, list(want), "STRING", naming.resolve_alias(F.col("x")).alias("n")):
        assert row.n == want[row.x]


def test_labels_previews_prompts(spark):
    labels = column(spark, ["openai:gpt-4o", "o1", "a:b:c"], "STRING", tx.model_label(F.col("x")).alias("l"))
    assert [r.l for r in labels] == ["gpt-4o", "o1", "b"]
    rows = column(spark, ["x" * 100, "x" * 101], "STRING", tx.preview(F.col("x")).alias("p"))
    assert [len(r.p) for r in rows] == [100, 103]
    prompt = column(spark, ["$1 {review}"], "STRING", tx.render_prompt("{review}|{review}", F.col("x")).alias("p"))
    assert prompt[0].p == "$1 {review}|$1 {review}"


def test_timestamps(spark):
    at = F.to_timestamp(F.lit("2025-01-02 03:04:05.000006"))
    row = spark.range(1).select(
        tx.report_name(at).alias("n"), tx.iso_timestamp(at).alias("i"), tx.display_timestamp(tx.iso_timestamp(at)).alias("s")
    ).first()
    assert tuple(row) == ("report_20250102_030405", "2025-01-02T03:04:05.000006", "2025-01-02 at 03:04")
