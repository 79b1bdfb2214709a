"""SimHash fingerprints linked by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two are linked if they differ in at most three. The bits are
four blocks of 16. At most three differ, so one block is free of errors, and the 48 bits
beside it, cut into two segments, have at most one error in one of the segments. 23 bits of
each segment are read as a word of the perfect binary Golay code (23, 12, 7): every word is
within three bits of exactly one codeword, and two words that differ in one bit share a
codeword within four bits of both. A word has one or six such codewords. The key of a
fingerprint is block, exact block bits, segment and codeword index; it has 8 to 48 keys, and
linked fingerprints share one. Candidates of a key are verified on all 64 bits.

A key that many fingerprints share is cut into chunks, and each pair of chunks is one
bounded group; a group returns a spanning forest of its links, never the pairs.

Cases: a null or empty text has fingerprint zero and is linked like any other. A text with
fewer words than a shingle is one shingle. Equal fingerprints are linked, so exact copies and
repeated rows share a class. Rows with a null doc_id take part; they do not name a class
unless nobody in it has an id, and its name is null then. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import as_bytes, components, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
# fingerprints per chunk of a key
CHUNK = 512
# shingles whose bits are counted at once
SLAB = 1 << 15

# generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
WORD_BITS, CHECK_BITS = 23, 11


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """Runs of `size` words, A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64."""
    parts = shingles(text, size)
    if not parts:
        return 0
    hashed = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashed), SLAB):
        bits = np.unpackbits(hashed[low : low + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashed), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        rest = {name: batch.column(name) for name in batch.schema.names[2:]}
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints), *rest.values()], names=["doc_id", "fp", *rest])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed number."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    unit = np.array([_remainder(1 << i) for i in range(WORD_BITS)], np.int64)
    out = np.zeros(words.shape, np.int64)
    for i in range(WORD_BITS):
        out ^= np.where((words >> i) & 1, unit[i], 0)
    return out


def _remainder(word: int) -> int:
    for i in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK_BITS)
    return word


@cache
def decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the errors to the nearest codeword, the number of codewords within
    four bits, and how the indices of those differ from the nearest one's."""
    messages = np.arange(1 << (WORD_BITS - CHECK_BITS), dtype=np.int64) << CHECK_BITS
    codewords = messages | syndromes(messages)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    number = np.ones(1 << CHECK_BITS, np.int64)
    differences = np.zeros((1 << CHECK_BITS, 6), np.int64)
    for weight in range(4):
        for places in combinations(range(WORD_BITS), weight):
            error = sum(1 << p for p in places)
            syndrome = _remainder(error)
            errors[syndrome] = error
            if weight == 3:  # the words of weight seven over these three places are four bits away
                over = sevens[(sevens & error) == error]
                number[syndrome] = 1 + len(over)
                differences[syndrome, 1:] = over >> CHECK_BITS
    return errors, number, differences


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which word, index of a codeword within four bits), for 23-bit words."""
    errors, number, differences = decoder()
    syndrome = syndromes(words)
    nearest = (words ^ errors[syndrome]) >> CHECK_BITS
    of = np.repeat(np.arange(len(words)), number[syndrome])
    nth = np.arange(len(of)) - np.repeat(np.cumsum(number[syndrome]) - number[syndrome], number[syndrome])
    return of, nearest[of] ^ differences[syndrome[of], nth]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key) for unsigned fingerprints."""
    of, keys = [], []
    for block in range(4):
        low = np.uint64(16 * block)
        exact = ((prints >> low) & np.uint64(0xFFFF)).astype(np.int64)
        below = prints & ((np.uint64(1) << low) - np.uint64(1))
        above = np.uint64(0) if block == 3 else (prints >> (low + np.uint64(16))) << low
        rest = (below | above).astype(np.int64)
        for segment in range(2):
            which, index = near_codewords(rest >> (24 * segment) & ((1 << WORD_BITS) - 1))
            of.append(which)
            keys.append(((2 * block + segment) << 28) | (exact[which] << 12) | index)
    return np.concatenate(of), np.concatenate(keys)


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for low in range(0, len(prints), 4096):
            part = prints[low : low + 4096]
            of, keys = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[of])], names=["key", "fp"])


def forest(prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the fingerprints as links of at most `max_bits` do; at most one per fingerprint."""
    labels = np.arange(len(prints))
    unsigned = prints.view(np.uint64)
    left, right = [], []
    for low in range(0, len(prints), CHUNK):
        near = np.bitwise_count(unsigned[low : low + CHUNK, None] ^ unsigned[None, :]) <= max_bits
        i, j = np.nonzero(near)
        i += low
        left.append(i[i < j])
        right.append(j[i < j])
    i, j = np.concatenate(left), np.concatenate(right)
    while len(i):
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        labels = labels[labels]
        if (labels == before).all():
            break
    while (labels != labels[labels]).any():
        labels = labels[labels]
    rest = np.flatnonzero(labels != np.arange(len(prints)))
    return prints[rest], prints[labels[rest]]


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group (key, i, j); one group at a time is held."""
    held: list[np.ndarray] = []

    def ended() -> pa.RecordBatch:
        a, b = forest(np.unique(np.concatenate(held)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    last = None
    for batch in batches:
        group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        prints = batch.column(3).to_numpy(zero_copy_only=False)
        if not len(prints):
            continue
        starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])
        for low, high in zip(starts, np.r_[starts[1:], len(prints)], strict=True):
            if last is not None and (group[:, low] != last).any():
                yield ended()
                held.clear()
            last = group[:, low]
            held.append(prints[low:high])
    if held:
        yield ended()


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `fp` exactly as all links would."""
    keyed = stored(prints.select("fp").mapInArrow(_keyed, "key bigint, fp bigint"), "fingerprint-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    others = F.sequence(F.lit(0), chunks - 1)
    dealt = (
        keyed.join(shared.hint("merge"), "key")
        .select("key", "fp", chunk.alias("c"), F.explode(others).alias("o"))
        .select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    )
    # groups are small in bytes and heavy in work, so their number of partitions is fixed for AQE not to merge them
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = dealt.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return groups.mapInArrow(_linked, "a bigint, b bigint")


def _rooted(named: DataFrame) -> DataFrame:
    """`named`, whose fingerprints `fp` are distinct, with the `root` of their class."""
    roots = stored(components(links(named)), "fingerprint-roots")
    return named.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def survivors(docs: DataFrame) -> DataFrame:
    """(doc_id, row): of each class the row of `docs` with the smallest doc_id, then the smallest number `row`.

    A row without a doc_id stays only if no row of its class has one.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint"), "text", "row")
    prints = chosen.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, row bigint")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    named = stored(prints.groupBy("fp").agg(F.min(first).alias("kept")), "fingerprint-rows")
    return _rooted(named).groupBy("root").agg(F.min("kept").alias("kept")).select("kept.doc_id", "kept.row")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs`."""
    prints = stored(fingerprints(docs), "fingerprints")
    rooted = _rooted(stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = stored(rooted.join(lowest, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(members.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
