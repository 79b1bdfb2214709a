"""The registered queries and the pipeline, held against SQL or plain Python at the smallest scale."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, difference
from replylens.llm import simhash
from replylens.llm.oracles import ORACLES
from replylens.llm.queries import QUERIES
from tests.llm.test_decontaminate import brute
from tests.llm.test_text_rules import deduped, measured

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
    assert QUERIES.keys() | {"pipeline"} <= queries().keys() and ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark, connect(SF), SF, name) == ""


def classes_of(rows):
    root = {i: i for i, _ in rows}
    prints = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows]
    for k, (i, a) in enumerate(prints):
        for j, b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {v: low if r == high else r for v, r in root.items()}
    return root


def test_stages_against_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    def failed(text):
        n, chars, symbols, dup, repeat = measured(text)
        lines = sum(bool(line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n"))
        return n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 15 * n

    want = [[(i, t) for i, t in rows if not failed(t)]]
    want.append([(i, kept) for i, _, _, kept in deduped(want[-1], 10).elements()])
    roots = classes_of(want[-1])
    want.append([(i, t) for i, t in want[-1] if roots[i] == i])
    want.append([(i, t) for i, t in want[-1] if not brute(t, items)[1]])
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert sorted(got) == sorted(expected), name
        docs = corpus_pipeline.stored(out, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == {i for i, _ in want[-1]}
    for i, text in want[-1]:
        ids = b"".join(r.ids for r in sorted(pieces[i], key=lambda r: r.piece))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r[c] for c in columns) for r in packed)


def test_stages_take_nulls_clashes_and_nothing(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (None, long), (2, long), (3, None), (4, ""), (2, long), (5, " ".join(f"v{i}" for i in range(90)))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "'en' lang", "'s' source", "1L n_chars", "1 doc", "2 key", "3 found", "4 `a.b`")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = corpus_pipeline.stored(stage(spark, table, SF), name)
            assert table.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, table, SF).count()
    kept = corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "5"]


def test_near_dedup_leaves_one_row_of_each_class(spark):
    texts = [" ".join(f"{letter}{i}" for i in range(80)) for letter in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (3, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[0]), (None, None), (4, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "'s' source")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs.repartition(5), SF).collect()]
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None), (4, texts[3])]
    assert sorted(got, key=str) == sorted(want, key=str)
    # rows that differ only in which column is null are told apart
    pair = spark.createDataFrame([(1, "a", "x", None), (1, "a", None, "x")], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    assert corpus_pipeline.near_dedup(spark, pair, SF).count() == 1
