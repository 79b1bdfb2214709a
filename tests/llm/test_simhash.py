"""Fingerprints and their classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from replylens.llm import simhash


def plain_fingerprint(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    chosen = random.Random(1)
    texts = ["", " \n", "one", "One TWO", "É b c d", "a\x1cb c\x0bd"] + [" ".join(chosen.choices(["a", "b", "É", "dd"], k=chosen.randint(1, 50))) for _ in range(50)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_are_counted_in_slabs(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLAB", 64)
    assert simhash.fingerprint(text) == whole


def test_words_two_bits_apart_share_a_codeword():
    random_words = np.random.default_rng(2).integers(0, 1 << 23, 3000)
    near = random_words ^ (1 << np.random.default_rng(3).integers(0, 23, 3000)) ^ (1 << np.random.default_rng(4).integers(0, 23, 3000))
    keys = [set(zip(*(x.tolist() for x in simhash.near_codewords(w)), strict=True)) for w in (random_words, near)]
    assert {of for of, _ in keys[0] & keys[1]} == set(range(3000))
    assert set(np.bincount(simhash.decoder()[1])) == {0, 277, 1771}


def test_links_share_a_key():
    chosen = random.Random(5)
    for _ in range(300):
        a = chosen.getrandbits(64)
        b = a
        for bit in chosen.sample(range(64), 3):
            b ^= 1 << bit
        of, keys = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[of == 0]) & set(keys[of == 1])


def by_all_pairs(prints):
    values = sorted(set(prints))
    root = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                low, high = root[a], root[b]
                if low != high:
                    root = {v: low if r == high else r for v, r in root.items()}
    return root


@pytest.mark.parametrize("chunk", [4, 512])
def test_classes_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    chosen = random.Random(6)
    prints = [chosen.getrandbits(64) for _ in range(150)]
    # a dense cluster, a chain, and near copies
    prints += [prints[0] ^ (1 << chosen.randrange(64)) ^ (1 << chosen.randrange(64)) for _ in range(80)]
    walk = prints[1]
    for _ in range(40):
        for bit in chosen.sample(range(64), 3):
            walk ^= 1 << bit
        prints.append(walk)
    prints = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in set(prints)], "fp BIGINT")).collect()
    root = {p: p for p in set(prints)}
    for a, b in links:
        low, high = root[a], root[b]
        if low != high:
            root = {v: low if r == high else r for v, r in root.items()}
    classes = lambda r: {frozenset(v for v in r if r[v] == x) for x in r.values()}
    assert classes(root) == classes(by_all_pairs(prints))
    assert len(links) <= 60 * len(set(prints))


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text + " more"), (None, text), (8, None), (7, ""), (2, "something else altogether here"), (2, "something else altogether here"), (None, "alone without an id")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 fp", "2 key", "3 component_id")
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.component_id) for r in got}
    assert {(5, 3), (3, 3), (8, 7), (7, 7), (2, 2), (None, 3), (None, None)} <= found
    near = (simhash.fingerprint(text.encode()) ^ simhash.fingerprint((text + " more").encode())).bit_count()
    assert ((9, 3) in found) == (near <= 3)
    assert simhash.classes(docs.limit(0)).count() == 0
