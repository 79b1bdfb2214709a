"""Held-out accuracy, and the cases without data."""

import zlib

import numpy as np
import pytest

from replylens.llm import toxicity
from replylens.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    rows = rows[rows["held_out"]]
    rank = rows["score"].rank()
    toxic = rows["toxic"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()
    assert auc > 0.85
    assert rows.loc[~toxic, "predicted"].mean() < 0.1 and rows.loc[toxic, "predicted"].mean() > 0.6


@pytest.fixture(scope="module")
def model():
    toxic = [b"the weather is fine today you idiot and the sun is out %d" % i for i in range(60)]
    return toxicity.fit(toxic, [t.replace(b"you idiot", b"my friend") for t in toxic])


def test_small_models_tell_apart(model):
    scores = model.scores([b"the sun is out you idiot", b"the sun is out my friend", b""])
    assert scores[0] > scores[1] and 0 <= scores.min() <= scores.max() <= 1


def test_fits_are_repeatable(model):
    assert model.scores([b"x" * 5000]).tolist() == model.scores([b"x" * 5000]).tolist()


def test_missing_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (1, "a b")], "doc_id BIGINT, text STRING").selectExpr("*", "1 toxic", "2 score")
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    sample = toxicity.labelled_sample(docs, none)
    assert sample == ([], [])
    got = toxicity.score_documents(docs, toxicity.fit(*sample)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0}
    assert toxicity.fit([b"bad"], []).scores([b"x"]).tolist() == [1.0]
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1), (1, 0), (1, 1)], "doc_id BIGINT, toxic INT")
    assert len(toxicity.labelled_sample(docs, odd)[0]) == (0 if zlib.crc32(b"1") % 3 == 1 else 2)


def test_one_text_per_label():
    model = toxicity.fit([b"bad words here"], [b"good words there"])
    assert np.isfinite(model.scores([b"", b"bad", b"good words" * 1000])).all()


def test_windows_cover_a_text():
    for size in (1, 31, 32, 33, 52, 53, 1000):
        text = bytes(i % 251 for i in range(size))
        parts = toxicity.windows(text)
        assert parts[-1][-1:] == text[-1:] and all(0 < len(p) <= toxicity.WINDOW for p in parts)
        assert len(toxicity.savings(text, (toxicity.compressor(b"abc" * 50), toxicity.compressor(b"xyz" * 50)))) == len(parts)


def test_the_sample_keeps_its_bounds_where_ids_repeat(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    docs = spark.createDataFrame([(i, "x" * 30) for i in ids for _ in range(29 if i == ids[0] else 1)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id BIGINT, toxic INT")
    for most in (10, 30, 200, 900, 10**6):
        toxic, ordinary = toxicity.labelled_sample(docs, labels, rows=12, most_bytes=most)
        assert sum(map(len, toxic)) <= most and sum(map(len, ordinary)) <= most
        assert len(set(toxic)) <= 1 and len(toxic) <= 12 + 28


def plain_scores(model, texts):
    """Scores recomputed window by window with compressors of their own."""
    import math

    import zstandard

    out = []
    for text in texts:
        text, saved = text.lower(), []
        for low in range(0, max(len(text) - 32 + 20, 1) if text else 0, 20):
            lengths = []
            for content in (model.ordinary, model.toxic):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
                lengths.append(len(packer.compress(text[low : low + 32])))
            saved.append(lengths[0] - lengths[1])
        n = max(len(saved), 1)
        over = [sum(s >= v for s in saved) for v in (-2, -1, 1, 2, 3, 4, 5, 6, 7, 8)]
        row = (sorted(saved, reverse=True) + [0] * 3)[:3]
        row += [sum(saved) / n, sum(max(s, 0) for s in saved) / n, math.log(1 + n), *[math.log(1 + o) for o in over], *[o / n for o in over]]
        z = model.constant + sum((x - c) / s * w for x, c, s, w in zip(row, model.centre, model.scale, model.weights, strict=True))
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


def test_scores_against_a_plain_recomputation(spark, model):
    texts = ["", None, "You IDIOT", "the weather is fine", "x" * 31, "é" * 333, " ".join(f"word{i} idiot" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = [r.score for r in toxicity.score_documents(docs, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(plain_scores(model, [(t or "").encode() for t in texts]), abs=1e-9)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
