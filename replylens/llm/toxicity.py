"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries begin as one trained on ordinary text, so what every text has in common
costs the same with either. One is extended by a dictionary trained on the passages that set
toxic documents apart, the other by as many bytes trained on further ordinary text. Short
overlapping windows are compressed with both; a window is suspicious if the toxic dictionary saves
bytes. A document's largest savings and the share of suspicious windows give its score by a
logistic curve that is fitted on labelled documents the dictionaries have not seen, and moved so that the
best threshold on them lies at `THRESHOLD`.

Only text is an input of a score. The model is fitted on the driver on a bounded sample of
labelled rows: at most `SAMPLE_ROWS` of each label and `SAMPLE_BYTES` of text per label, in the order
of a hash. Cases: a null or empty text has no windows and gets the score of an unsuspicious one. Labels that
repeat count once, toxic if any says so; null labels and labels without a document are ignored. If a label
has no rows, every score is 0 (no toxic rows) or 1 (no ordinary ones). Long texts are scored whole.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import as_bytes

WINDOW, STRIDE = 32, 20
LEVEL = 3
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 24_000_000
THRESHOLD = 0.7

BASE_BYTES = 64 << 10
# what the extensions are chosen from: their sizes and the length of the runs they are made of
EXTRA_BYTES, EXTRA_RUNS = (1000, 1500, 2500), (24, 50)
CHOICE_ROWS = 400
# runs of so many bytes, and words, are compared between the labels; how much more frequent they have to be
GRAM, MIN_Z, MIN_RATIO = 6, 6.0, 20.0
WORD = re.compile(rb"[a-z\x80-\xff]+")
# windows are counted by the bytes that the toxic dictionary saves at least
LEVELS = (-2, -1, 1, 2, 3, 4, 5, 6, 7, 8)
# at most so many training windows of each kind
TRAIN_WINDOWS = 60_000


def folded(text: bytes) -> bytes:
    return text.lower()


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(len(text) - WINDOW + STRIDE, 1), STRIDE)] if text else []


def grams(text: bytes) -> np.ndarray:
    """A hash of each run of GRAM bytes."""
    codes = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(len(codes) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM if len(out) else 0):
        out = out * np.uint64(1099511628211) + codes[i : i + len(out)]
    return out


def tokens(text: bytes) -> list[bytes]:
    """Words with the space before and after them."""
    return [b" " + w + b" " for w in WORD.findall(text)]


def telling(toxic: list[bytes], ordinary: list[bytes], parts: Callable[[bytes], Iterable]) -> set:
    """The parts whose share of toxic texts exceeds that of ordinary texts clearly."""
    in_toxic, in_ordinary = (Counter(p for t in texts for p in set(parts(t))) for texts in (toxic, ordinary))
    out = set()
    for part, n in in_toxic.items():
        m = in_ordinary[part]
        p, q = (n + 0.5) / (len(toxic) + 1), (m + 0.5) / (len(ordinary) + 1)
        both = (n + m + 1) / (len(toxic) + len(ordinary) + 2)
        if p >= MIN_RATIO * q and p - q >= MIN_Z * math.sqrt(both * (1 - both) * (1 / len(toxic) + 1 / len(ordinary))):
            out.add(part)
    return out


def passages(text: bytes, runs: np.ndarray, words: set[bytes]) -> list[bytes]:
    """The stretches of a text that telling runs cover, and its telling words."""
    out = [w for w in tokens(text) if w in words]
    found = grams(text)
    hits = np.flatnonzero(np.isin(found, runs)) if len(runs) else found[:0]
    if len(hits):
        cuts = np.flatnonzero(np.diff(hits) > 1) + 1
        out += [text[part[0] : part[-1] + GRAM] for part in np.split(hits, cuts)]
    return out


def trained(samples: list[bytes], size: int, **options: int) -> bytes:
    """A trained dictionary; if there are too few samples for that, the most frequent ones."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s for s, _ in reversed(Counter(samples).most_common(size // WINDOW)))[-size:]


@dataclass
class Model:
    """The two dictionaries and the curve from features to scores."""

    ordinary: bytes
    toxic: bytes
    centre: list[float]
    scale: list[float]
    weights: list[float]
    constant: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.curve(features(texts, self.ordinary, self.toxic)) if self.weights else np.full(len(texts), self.constant)

    def curve(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.centre) / self.scale @ np.array(self.weights) + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def savings(text: bytes, pair: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that the second dictionary saves against the first, per window."""
    starts = np.arange(0, max(len(text) - WINDOW + STRIDE, 1), STRIDE, dtype=np.uint64)
    out = []
    for low in range(0, len(starts) if text else 0, 8192):
        part = starts[low : low + 8192]
        segments = np.stack([part, np.minimum(np.uint64(WINDOW), np.uint64(len(text)) - part)], axis=1)
        lengths = [np.array([len(s) for s in c.multi_compress_to_buffer(zstandard.BufferWithSegments(text, segments.tobytes()))]) for c in pair]
        out.append(lengths[0] - lengths[1])
    return np.concatenate(out) if out else np.zeros(0, int)


def features(texts: list[bytes], ordinary: bytes, toxic: bytes) -> np.ndarray:
    pair = (compressor(ordinary), compressor(toxic))
    rows = []
    for text in texts:
        saved = np.sort(savings(folded(text), pair))[::-1].astype(float)
        n = max(len(saved), 1)
        top = np.zeros(3)
        top[: min(3, len(saved))] = saved[:3]
        over = np.array([(saved >= v).sum() for v in LEVELS], float)
        rows.append([*top, saved.sum() / n, saved.clip(0).sum() / n, np.log1p(n), *np.log1p(over), *(over / n)])
    return np.array(rows, float).reshape(len(texts), 6 + 2 * len(LEVELS))


def _logistic(rows: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the labels weigh alike in sum."""
    x = np.c_[rows, np.ones(len(rows))]
    share = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    ridge = np.diag([penalty] * rows.shape[1] + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (labels - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    """The chance that a toxic document scores above an ordinary one."""
    order = np.argsort(scores, kind="stable")
    below = np.cumsum(labels[order] == 0)
    return float(below[labels[order] == 1].mean() / max((labels == 0).sum(), 1))


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries from two thirds of each label, the curve from the rest."""
    if not toxic or not ordinary:
        return Model(b"", b"", [], [], [], float(not ordinary and bool(toxic)))
    # copies count once
    toxic, ordinary = [list(dict.fromkeys(folded(t) for t in texts)) for texts in (toxic, ordinary)]
    learn = lambda texts: [t for i, t in enumerate(texts) if i % 3] or texts
    runs = telling(learn(toxic), learn(ordinary), lambda t: np.unique(grams(t)).tolist())
    words = telling(learn(toxic), learn(ordinary), tokens)
    told = np.array(sorted(runs), np.uint64)
    # one sample per document, its telling passages joined: the trainer passes over very short samples
    apart = [p for t in learn(toxic) if (p := b"".join(passages(t, told, words)))]
    common = [w for t in learn(ordinary) for w in windows(t)]
    random.Random(0).shuffle(common)
    base = trained(common[:TRAIN_WINDOWS], BASE_BYTES)
    further = common[TRAIN_WINDOWS : 2 * TRAIN_WINDOWS] or common
    telling_samples = (apart or [w for t in learn(toxic) for w in windows(t)])[:TRAIN_WINDOWS] * 4

    def candidate(size: int, run: int) -> Model:
        extra, told = (trained(samples, size, k=run, d=6) for samples in (further, telling_samples))
        return Model(extra + base, base + told, [], [], [])

    def fitted(model: Model, some: list[bytes], others: list[bytes]) -> tuple[Model, np.ndarray, np.ndarray]:
        labels = np.r_[np.ones(len(some)), np.zeros(len(others))]
        rows = features(some + others, model.ordinary, model.toxic)
        centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        weights, constant = _logistic((rows - centre) / scale, labels)
        done = Model(model.ordinary, model.toxic, centre.tolist(), scale.tolist(), weights.tolist(), constant)
        return done, (rows - centre) / scale @ weights + constant, labels

    # the sizes of the extensions are chosen on documents that no dictionary has seen
    few, many = toxic[::3][:CHOICE_ROWS], ordinary[::3][:CHOICE_ROWS]
    choices = [candidate(size, run) for size in EXTRA_BYTES for run in EXTRA_RUNS]
    chosen = max(choices, key=lambda c: area(*fitted(c, few, many)[1:]))
    model, z, labels = fitted(chosen, toxic[::3], ordinary[::3])
    # move the curve so that the threshold with the best F1 lies at THRESHOLD
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(labels[order])
    best = int(np.argmax(2 * right / (np.arange(1, len(z) + 1) + labels.sum())))
    cut = (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
    model.constant += float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[bytes]]:
    """(toxic, ordinary) texts of labelled documents that are not held out; bounded by rows and bytes."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    judged = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = judged.where("toxic = 1").orderBy(order).limit(rows).unionByName(judged.where("toxic = 0").orderBy(order).limit(rows))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    # at most `rows` ids per label, however many rows share one; the texts of an id count together
    sizes = texts.groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("size"), F.first(order).alias("nth")).collect()
    within: set = set()
    for label in (1, 0):
        left = most_bytes
        for row in sorted((r for r in sizes if r["toxic"] == label), key=lambda r: r["nth"]):
            if row["size"] <= left:
                left -= row["size"]
                within.add(row["doc_id"])
    picked: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(texts.where(F.col("doc_id").isin(list(within)) if len(within) < len(sizes) else F.lit(True)).collect(), key=lambda r: (r["doc_id"], r["text"])):
        picked[row["toxic"]].append(row["text"].encode())
    return picked[1], picked[0]


def _scored(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scored(model), "doc_id long, score double")
