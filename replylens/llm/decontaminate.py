"""Benchmark decontamination with an Aho-Corasick automaton over the items' word windows.

Items and documents are normalised alike: A-Z in lower case, every other ASCII character
that is neither letter nor digit a separator, words joined by one space. The automaton
holds each window of `WINDOW` consecutive item words (an item of fewer words is one window)
between spaces, so a match begins and ends at words. A document is scanned once; a match is
mapped through the words' offsets back to the original text.

Items up to BLOCK_BYTES make one automaton. More items are read in blocks of that size, each with an automaton of its own; every
document meets every block, and each block leaves only the hits of the documents that it hits. These narrow rows are merged and joined to
the documents once; documents themselves are not written again for a block.

Cases: a null or empty text has no words and no hits; an item without words never matches.
Repeated items count once per item_id, repeated documents each for itself. Other columns are
not read unless carried by name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.llm.common import stored
from replylens.session import join_bounded

WINDOW = 10
# bytes of item texts in one automaton
BLOCK_BYTES = 4_000_000

# words of the text as it is, with A-Z
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# per byte of UTF-8: letters lowered, digits and non-ASCII kept, else a space
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def normalised(text: str) -> list[str]:
    return text.encode().translate(NORMAL).decode().split(" ") if text else []


def words(text: str | None) -> list[str]:
    """The words of a text; only the space separates after normalisation."""
    return [w for w in normalised(text or "") if w]


class Windows:
    """The automaton of a block of items and, per pattern, its length in words and its items."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        found: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            parts = words(text)
            for i in range(max(1, len(parts) - size + 1)) if parts else ():
                run = parts[i : i + size]
                found.setdefault(f" {' '.join(run)} ", (len(run), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, value in found.items():
            self.automaton.add_word(pattern, value)
        if found:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, merged hit ranges of word places, items with an occurring window)."""
        parts = words(text)
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        if not parts or not len(self.automaton):
            return len(parts), hits, items
        ends = None
        for end, (length, owners) in self.automaton.iter(f" {' '.join(parts)} "):
            if ends is None:  # place of the space after each word
                ends = np.cumsum([len(w) + 1 for w in parts])
            last = int(np.searchsorted(ends, end)) + 1
            hits.append((last - length, last))
            items |= owners
        return len(parts), merged(hits), items


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap that cover the same places."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def spans_of(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit ranges of words as code point spans of the original text."""
    if not hits:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[low][0], places[high - 1][1]) for low, high in hits]


# the automaton a Python worker holds, by the name of its block
_BUILT: dict[str, Windows] = {}


def _windows(name: str, block: Broadcast) -> Windows:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(block.value)
    return _BUILT[name]


def _described(text: str | None, n: int, hits: list[tuple[int, int]], items: Iterable[str]) -> dict:
    return {
        "n_words": n,
        "hits": [{"start": a, "end": b} for a, b in hits],
        "items": sorted(items),
        "spans": [{"start": a, "end": b} for a, b in spans_of(text or "", hits)],
    }


def _with_found(batch: pa.RecordBatch, rows: list[dict], without: int) -> pa.RecordBatch:
    """The first columns of a batch, all but `without`, and the results."""
    kept = batch.num_columns - without
    return pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(rows, FOUND_ARROW)], names=[*batch.schema.names[:kept], "found"])


def _scanner(block: Broadcast):
    """Function for mapInArrow over rows with a text: all that one automaton finds."""
    name = uuid.uuid4().hex

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(name, block)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield _with_found(batch, [_described(t, *windows.scan(t)) for t in texts], 0)

    return scan


def _hits_of(block: Broadcast):
    """Function for mapInArrow over (key, text): the hits and items of the texts that a block hits."""
    name = uuid.uuid4().hex

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(name, block)
        for batch in batches:
            found = [(k, hits, items) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, hits, items in [windows.scan(t)] if hits]
            keys, hits, items = ([list(c) for c in zip(*found, strict=True)]) if found else ([], [], [])
            ranges = pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], _RANGES)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), ranges, pa.array([sorted(i) for i in items], pa.list_(pa.string()))], names=["key", "hits", "items"])

    return scan


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last two columns are the hits and items of all blocks, as results."""
    for batch in batches:
        rows = []
        for text, hits, items in zip(*(batch.column(c).to_pylist() for c in ("text", "all_hits", "all_items")), strict=True):
            rows.append(_described(text, len(words(text)), merged((h["start"], h["end"]) for h in hits or ()), items or ()))
        yield _with_found(batch, rows, 2)


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", RANGES),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", RANGES),
    ]
)
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("hits", _RANGES), ("items", pa.list_(pa.string())), ("spans", _RANGES)])


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items (item_id, text) in blocks of about `block_bytes`; one block is held at a time."""
    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def scan(docs: DataFrame, items: DataFrame, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, found): n_words, hit word ranges, items and spans of the original text.

    `carry` names further columns of `docs` to keep.
    """
    spark = docs.sparkSession
    current = docs.select("doc_id", "text", *(carry or []))
    schema = T.StructType([*current.schema.fields, T.StructField("found", FOUND)])
    dropped = [] if "text" in (carry or []) else ["text"]
    blocks = item_blocks(items, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return current.mapInArrow(_scanner(spark.sparkContext.broadcast(first)), schema).drop(*dropped)
    # equal rows have equal results, so they share a key
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    texts = docs.select(key.alias("key"), "text").where("text is not null")
    narrow = None
    for block in chain((first, second), blocks):
        held = spark.sparkContext.broadcast(block)
        found = texts.mapInArrow(_hits_of(held), T.StructType([T.StructField("key", T.StringType()), FOUND["hits"], FOUND["items"]]))
        found = stored(found.dropDuplicates(["key"]), "contamination")
        held.unpersist()
        narrow = found if narrow is None else narrow.unionByName(found)
    # a row per document and block that hits it
    every = narrow.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("all_hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("all_items"))
    joined = join_bounded(current.withColumn("key", key), every, ["key"], "left").select(*current.columns, "all_hits", "all_items")
    return joined.mapInArrow(_finished, schema).drop(*dropped)


def n_hit(found: Column) -> Column:
    """Words of a document inside occurrences of windows."""
    return F.aggregate(found["hits"], F.lit(0).cast("bigint"), lambda total, hit: total + hit["end"] - hit["start"])
