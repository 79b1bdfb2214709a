"""Runs against all pairs of places, at lags below and beyond those that are scanned."""

import hashlib
import random
import time
import zlib

import numpy as np

from replylens.llm import periodic_runs as runs
from replylens.llm.queries import op13_periodic_runs


def brute_force(words):
    """(start, length, period) of every run, by comparing all lags at all places."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(12, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(chosen):
    """Word numbers with periods inside periods, repeated roots out of step, and plain noise."""

    def unit(n, kinds):
        return [chosen.randrange(kinds) for _ in range(n)]

    kind = chosen.randrange(6)
    if kind == 0:
        return unit(chosen.randint(0, 300), chosen.choice([1, 2, 3]))
    if kind == 1:
        root = unit(chosen.randint(1, 150), chosen.choice([2, 3, 50]))
        return unit(20, 3) + (root * 4)[: chosen.randint(len(root), 4 * len(root))] + unit(20, 3)
    if kind == 2:
        root = (unit(chosen.randint(1, 6), 2) * 60)[chosen.randint(0, 5) :]
        return (root[: chosen.randint(60, len(root)) if len(root) > 60 else len(root)] * 3)[: chosen.randint(100, 700)]
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < chosen.randint(200, 500):
            a, b = b, b + a
        return b
    if kind == 4:
        inner = unit(chosen.randint(1, 5), 2) * chosen.randint(8, 30) + unit(chosen.randint(0, 3), 2)
        return (inner * chosen.randint(2, 6))[: chosen.randint(200, 800)]
    out = []
    while len(out) < chosen.randint(200, 700):
        out += unit(chosen.randint(1, 9), 2) * chosen.randint(1, 40)
    return out


def test_runs_equal_brute_force():
    chosen, far = random.Random(5), 0
    for _ in range(300):
        words = texts(chosen)
        expected = brute_force(words)
        assert [tuple(r) for r in runs.periodic_runs(np.array(words, np.int32)).tolist()] == expected, words
        far += sum(q >= runs.DIRECT for _, _, q in expected)
    assert far > 300


def test_work_does_not_grow_with_the_square():
    for words in ([0] * 200_000, [0, 1] * 50_000 + [0, 0] + [1, 0] * 50_000, [i % 28_571 for i in range(200_000)]):
        began = time.monotonic()
        assert len(runs.periodic_runs(np.array(words, np.int32)))
        assert time.monotonic() - began < 20


def described(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_force(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(collapsed).hexdigest(),
    )


def test_query_equals_brute_force(spark, tmp_path):
    chosen = random.Random(11)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:25] + list(range(2000, 2060)) + [None, 7, 7]
    rows = [(i, " \t".join(f"w{w}" for w in texts(chosen))) for i in ids]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "é\u00a0b " * 30), (5, "x " * 4000), rows[0]]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 start", "2 runs", "3 h")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((described(*r) for r in rows), key=str)
    assert {r[0] for r in got if r[4] and r[4] >= runs.DIRECT}


def test_empty_table(spark):
    assert runs.find_runs(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_one_row_with_spans(spark):
    row = runs.find_runs(spark.createDataFrame([(1, "a " + "b c " * 6 + "d")], "doc_id BIGINT, text STRING")).first()
    assert [tuple(r) for r in row.runs] == [(1, 12, 2)] and row.collapsed == "a b c d"
