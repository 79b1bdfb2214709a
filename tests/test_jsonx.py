import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from replylens.functions.jsonx import structure_score, with_json

TEXTS = [
    '{"a":1}', 'Here: {"a":1} bye', '{"a":1} {"b":2}', '[{"a":1},{"b":2}]', "{}", "123", "null", '"s"', "Error: x",
    '{"a":1,"a":2}', "{'a':1}", "", " ", "{ }", "[ ]", "[]", '""', "0", "0.0", "-0", "1e-400", "false", "true",
    '{"a":1}x', "} {", '{"a":"x\ny"}', "[1],[2", "1,2", '{"a":{"b":[1,2,{}]}}', ' {"a":1} ', "[1]", '"a" b',
    '{"é":"ü"}', '{"a":1,}', "01", '{"a\\u0062":1,"ab":2}', '" "', "0e5", '{"":1}', "\t[1]\n", "nul", "tru",
    '{"a":1}}', '{{"a":1}', '"\\ud800"', "-", "[1,]", '"\x01"', '{"a":"\t"}', '"\\x"', "\x0b1", "\xa01",
    '{"a":' + "9" * 50 + "}", "text { not json } and [1]", '{"x": 1} trailing }', '{"b":1,"a":{"c":2}}',
]


def valid(text):
    span = re.search(r"\{[\s\S]*\}", text)
    try:
        json.loads(span.group(0) if span else text)
        return True
    except ValueError:
        return False


def extracted(text):
    span = re.search(r"\{[\s\S]*\}", text)
    for candidate in ([span.group(0)] if span else []) + [text]:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def expected(text):
    value = extracted(text)
    keys = sorted(value) if isinstance(value, dict) and value else None
    return valid(text), bool(value), keys


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, response STRING")
    for row in with_json(df).collect():
        assert (row.json_valid, row.json_truthy, row.json_keys) == expected(texts[row.i]), repr(texts[row.i])


def test_against_python(spark):
    check(spark, TEXTS)


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text("ab{}[]\",: \\", max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("abc", max_size=2), inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from(["", " ", "x ", "{", "}", ","]), json_values, st.sampled_from(["", "\n", "}", " y", "]"])),
        min_size=30,
        max_size=60,
    )
)
def test_random_texts_against_python(spark, parts):
    check(spark, [before + json.dumps(value) + after for before, value, after in parts])


def test_null_reply(spark):
    row = with_json(spark.createDataFrame([(None,)], "response STRING")).first()
    assert (row.json_valid, row.json_text, row.json_truthy, row.json_keys) == (False, None, False, None)


def test_structure_score(spark):
    texts = [('{"service":1,"food":2}',), ("[1]",), ('{"x":1}',)]
    keys = ["service", "food", "value", "environment", "availability"]
    df = with_json(spark.createDataFrame(texts, "response STRING"))
    scores = [r[0] for r in df.select(structure_score(df.json_keys, keys)).collect()]
    assert scores == [0.4, 0.0, 0.0]


def test_filters_do_not_copy_the_parsing(spark):
    df = with_json(spark.range(3).selectExpr("cast(id as string) response")).filter("json_truthy and json_valid")
    assert df._jdf.queryExecution().executedPlan().toString().count("parseJson") <= 2


def test_unbalanced_braces_stay_linear(spark):
    text = "{" * 400_000
    assert with_json(spark.createDataFrame([(text,)], "response STRING")).first().json_valid is False
