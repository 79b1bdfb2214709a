"""The automaton against word windows compared one by one."""

import random
import re

import pytest

from replylens.llm import decontaminate
from replylens.llm.queries import QUERIES  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute(text, items):
    words, hit, owners = WORD.findall(lowered(text)), set(), set()
    for item, body in items:
        parts = WORD.findall(lowered(body))
        size = min(10, len(parts))
        windows = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                owners.add(str(item))
    return len(words), len(hit), sorted(owners)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_windows(spark, block_bytes):
    chosen = random.Random(4)
    words = ["Ab", "c", "é", "É", "10", "x"]
    items = [(i, " ".join(chosen.choices(words, k=chosen.choice([1, 3, 10, 14])))) for i in range(8)]
    items += [(100, None), (101, "?!"), (102, "Only, one-window!"), (None, "ab c"), (0, "another text of item zero")]
    rows = [(i % 30, " ".join(chosen.choices([*words, "-", "Y."], k=chosen.randint(0, 60)))) for i in range(40)]
    rows += [rows[0]] * 5 + [(99, "word " * 200_000 + "only one window"), (99, "")]
    rows += [(1, None), (None, ""), (None, "c c c only one window"), (50, "ONLY one;\nwindow"), (51, "honly one windows"), (52, "Another text of item zero.")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 found", "2 hits")
    table = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = decontaminate.scan(docs, table, block_bytes=block_bytes).withColumn("n_hit", decontaminate.n_hit(decontaminate.F.col("found"))).collect()
    named = [i for i in items if i[0] is not None]
    found = sorted((str(r.doc_id), r.found.n_words, r.n_hit, r.found["items"]) for r in got)
    assert found == sorted((str(i), *brute(t, named)) for i, t in rows)


def test_blocks_leave_only_hits(spark, monkeypatch):
    kept, plain = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: kept.append(plain(df, name)) or kept[-1])
    docs = spark.range(200).selectExpr("id doc_id", "repeat('plain words ', 50) || if(id = 7, 'one two three', 'none') text", "'c' kept")
    items = spark.createDataFrame([(i, f"one two three {'' if i == 0 else i}") for i in range(20)], "item_id BIGINT, text STRING")
    found = decontaminate.scan(docs, items, carry=["kept"], block_bytes=40).where("size(found.hits) > 0").collect()
    assert [(r.doc_id, r.kept, r.found["items"]) for r in found] == [(7, "c", ["0"])]
    assert len(kept) > 4 and sum(k.count() for k in kept) == 1 and all("text" not in k.columns for k in kept)


def test_spans_are_those_of_the_original(spark):
    item = "one two three four five six seven eight nine ten eleven"
    text = "Start: ONE, two-Three four  Five six\nseven EIGHT nine ten; eleven! end"
    windows = decontaminate.Windows([("q", item)])
    _, hits, owners = windows.scan(text)
    assert owners == {"q"} and [text[a:b] for a, b in decontaminate.spans_of(text, hits)] == [text[7:-5]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([], "item_id BIGINT, text STRING")
    row = decontaminate.scan(docs, items).first()
    assert (row.found.n_words, row.found.hits, row.found["items"]) == (2, [], [])
    assert decontaminate.scan(docs.limit(0), items).count() == 0
