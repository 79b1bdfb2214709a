"""Quality rules, line dedup and the pieces they share, against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from replylens.llm import line_dedup, quality
from replylens.llm.common import components

SPACES = re.compile(r"[\x20\x09-\x0D]+")
ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "a b c a b c a b"),
    (5, "one two\none two\n\n one two\nthree \xa0 é#* %"),
    (6, "x " * 5000 + "end"),
    (7, " ".join(f"w{i}" for i in range(60))),
    (7, " ".join(f"w{i}" for i in range(60))),
    (None, "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # names that an operator might use for itself
    return spark.createDataFrame(ROWS, "doc_id BIGINT, text STRING").selectExpr("*", "'x' doc", "1 id", "2 digest", "'k' key", "3 `a.b`")


def measured(text):
    body = text or ""
    words = [w for w in SPACES.split(body) if w]
    lines = [line for line in body.split("\n") if SPACES.sub("", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(covered))


def test_measurements(docs):
    got = quality.ledger(docs).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == Counter((i, *measured(t)) for i, t in ROWS)
    assert {r.doc_id for r in got if not r.failed} == {7}


def test_random_repeats(spark):
    chosen = random.Random(1)
    rows = [(i, " ".join(chosen.choice("abcd") for _ in range(chosen.randint(0, 40)))) for i in range(200)]
    got = {r.doc_id: r.n_repeat_words for r in quality.measure(spark.createDataFrame(rows, "doc_id INT, text STRING")).collect()}
    assert got == {i: measured(t)[4] for i, t in rows}


def test_policies_and_ablations(spark):
    ledger = spark.createDataFrame([(0,), (0,), (1,), (3,), (4,), (6,)], "failed INT")
    rows = {(r.policy, r.rule): (r.fails, r.only_this, r.kept_without, r.kept) for r in quality.ablations(ledger).collect()}
    assert rows["base", "few_words"] == (2, 1, 4, 3)
    assert rows["base", "repeated_windows"] == (2, 1, 4, 3)
    assert rows["default", "many_symbols"] == (2, 1, 3, 2)
    assert ledger.where(quality.passes(quality.BASE)).count() == 3


def test_rules_are_native(docs):
    plan = quality.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def deduped(rows, min_docs):
    key = lambda line: re.sub(r"[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    often = Counter(k for _, t in rows for k in {key(line) for line in (t or "").split("\n")} if k)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if often[key(line)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines_against_python(docs, spark):
    chosen = random.Random(2)
    lines = ["Menu", " menu\t", "É é", "é é", "", " ", *[f"line {i}" for i in range(30)]]
    rows = [(i % 90 or None, "\n".join(chosen.choice(lines) for _ in range(chosen.randint(0, 9)))) for i in range(120)] + [(1, None)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "'x' key", "1 id", "2 digest", "3 pos", "'d' doc")
    got = line_dedup.dedup_lines(table, min_docs=4).collect()
    assert Counter((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == deduped(rows, 4)
    assert all(r.doc.key == "x" and r.doc.doc == "d" for r in got)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert line_dedup.dedup_lines(empty).count() == 0 and quality.ledger(empty).count() == 0
    assert quality.ablations(quality.ledger(empty)).count() == 0


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(5):
        docs = spark.createDataFrame([(batch, f"shared\nonly {batch}")], "doc_id INT, text STRING")
        runs.add(line_dedup.line_counts(docs))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [r.key for r in runs.settled().collect()] == [hashlib.md5(b"shared").hexdigest()]
    # the run of the fifth batch lacks the line that was settled before it
    assert spark.read.parquet(runs.levels[0][0]).count() == 1
    # a later table is freed of what earlier ones settled
    later = line_dedup.dedup_lines(spark.createDataFrame([(9, "Shared \nnew")], "doc_id INT, text STRING"), runs=runs)
    assert later.first().kept_text == "new"


def test_components_against_union_find(spark):
    chosen = random.Random(3)
    links = [(chosen.randrange(400), chosen.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = components(spark.createDataFrame([*links, (None, 1)], "a BIGINT, b BIGINT")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == {x: root(x) for x in linked} and len(got) == len(linked)
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs).select(F.col("kept_text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
