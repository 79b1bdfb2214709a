"""Delimited text of any size, split into records in parallel.

A line break inside quotes belongs to its record, so whether a line begins a record depends on all quotes before
it. Files are read by Spark's splits; each split is walked once for both answers to "does it begin inside
quotes?" and gives two exit states. Per file these few pairs are composed in order, which
gives the state in which every split is really entered. With it splits are parsed independently; a record that
crosses splits is put together from its fragments. A record whose quotes never close ends with the file, without its last line break.

Positions are numbers that grow along a file: the begin of the split plus the number of the line in it. A
line takes at least one byte, so splits cannot overlap in them, and they do not depend on which task read what.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.session import BROADCAST_ROWS, durable

_QUOTED_FIELD = re.compile(rb',"')
_MARK = b"\xef\xbb\xbf"
_PINNED = "spark.sql.files.minPartitionNum"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether quotes are open after a line that was entered with them open or not.

    A quote opens a cell only as its first character; two quotes in a quoted cell are one of its text.
    """
    at = 0
    if not inside:
        if not line.startswith(b'"'):
            field = _QUOTED_FIELD.search(line)
            if field is None:
                return False
            at = field.end()
        else:
            at = 1
    while True:
        closing = line.find(b'"', at)
        if closing < 0:
            return True
        if line[closing + 1 : closing + 2] == b'"':
            at = closing + 2
            continue
        field = _QUOTED_FIELD.search(line, closing + 1)
        if field is None:
            return False
        at = field.end()


def cells_of(record: bytes) -> list[str]:
    """The cells of one record; none for an empty one. Bytes that are not UTF-8 are left out."""
    text = record.decode("utf-8", "ignore")
    if '"' not in text:
        text = text.rstrip("\r\n")
        return text.split(",") if text else []
    csv.field_size_limit(2**31 - 1)
    return next(csv.reader(io.StringIO(text, newline="")), [])


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, block, value): lines as bytes, with the begin of their split, in file order within it."""
    # two reads of a file must split it alike, whatever executors come and go between them
    if spark.conf.get(_PINNED, None) is None:
        spark.conf.set(_PINNED, str(spark.sparkContext.defaultParallelism))
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
        F.is_valid_utf8("value").alias("valid"),
    )


class _Lines:
    """The lines of one split after another, in turn, with their positions; a lone carriage return ends a line, too."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches = batches

    def splits(self) -> Iterator[tuple[tuple, Iterator[tuple[int, bytes, bytes, bool]]]]:
        """((source, block, further columns), lines as (pos, separator before it, line, valid)) per split."""
        rows = self._rows()
        self.ahead = next(rows, None)
        while self.ahead is not None:
            key = self.ahead[0]

            def lines(key=key) -> Iterator[tuple[int, bytes, bytes, bool]]:
                # lines of later splits begin after the split's first byte
                pos = key[1] + (key[1] > 0)
                while self.ahead is not None and self.ahead[0][:2] == key[:2]:
                    _, value, valid = self.ahead
                    if pos == 0 and value.startswith(_MARK):
                        value = value[len(_MARK) :]
                    head, *rest = value[:-1].split(b"\r") if b"\r" in value[:-1] else (value,)
                    if rest:
                        rest[-1] += value[-1:]
                    else:
                        head = value
                    yield pos, b"\n", head, valid
                    pos += 1
                    for piece in rest:
                        yield pos, b"\r", piece, valid
                        pos += 1
                    self.ahead = next(rows, None)

            walk = lines()
            yield key, walk
            for _ in walk:
                pass

    def _rows(self) -> Iterator[tuple[tuple, bytes, bool]]:
        for batch in self.batches:
            values, valid = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keys = [batch.column(i) for i in range(batch.num_columns) if i not in (2, 3)]
            # most batches lie in one split, whose key is made once
            if len(values) and all(pc.all(pc.equal(k, k[0])).as_py() for k in keys[:2]):
                key = tuple(k[0].as_py() for k in keys)
                yield from zip(repeat(key), values, valid)
            else:
                yield from zip(zip(*[k.to_pylist() for k in keys], strict=True), values, valid, strict=True)


SUMMARY = pa.schema(
    [
        ("source", pa.string()),
        ("block", pa.int64()),
        ("from_outside", pa.bool_()),
        ("from_inside", pa.bool_()),
        ("outside_start", pa.int64()),
        ("inside_start", pa.int64()),
        ("broken", pa.bool_()),
        ("names", pa.list_(pa.string())),
        ("first", pa.int64()),
        ("second_width", pa.int32()),
        ("top_width", pa.int32()),
    ]
)
SUMMARY_SQL = (
    "source string, block bigint, from_outside boolean, from_inside boolean, outside_start bigint, inside_start bigint, broken boolean, "
    "names array<string>, first bigint, second_width int, top_width int"
)


def _summaries(multi_line: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per split: the exit state and the last record begun for either entry state, and the first rows of a file."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, block), lines in _Lines(batches).splits():
            states, starts, broken = [False, True], [None, None], False
            heads: list[tuple[int, list[str]]] = []
            top, held = None, []
            for pos, separator, line, valid in lines:
                broken = broken or not valid
                if block == 0 and len(heads) < 2:
                    if states[0]:
                        held += [separator, line]
                    else:
                        start, held = pos, [line]
                before = states[0]
                for i, state in enumerate(states):
                    if not state:
                        starts[i] = pos
                if b'"' in line and multi_line:
                    states = [ends_inside(line, s) for s in states] if states[0] != states[1] else [ends_inside(line, before)] * 2
                if block == 0 and len(heads) < 2 and not states[0]:
                    cells = cells_of(b"".join(held))
                    top = len(cells) if top is None else top
                    if cells and (len(cells) > 1 or cells[0].strip(" \t")):
                        heads.append((start, cells))
            if not multi_line:
                states = [False, False]
            names, first = (heads[0][1], heads[0][0]) if heads else (None, None)
            row = (source, block, *states, *starts, broken, names, first, len(heads[1][1]) if len(heads) > 1 else None, top)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SUMMARY, strict=True)], schema=SUMMARY)

    return summarise


def _entered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, splits in order) as rows per split: the state and open record it is entered with, and the state it leaves."""
    for batch in batches:
        out: list[tuple] = []
        for source, splits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            inside, start = False, None
            for s in splits:
                leaves = s["from_inside"] if inside else s["from_outside"]
                begun = s["inside_start"] if inside else s["outside_start"]
                out.append((source, s["block"], inside, start if inside else None, leaves))
                start = start if begun is None else begun
                inside = leaves
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["source", "block", "inside", "start", "leaves"])


def _parsed(multi_line: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records that begin and end in one split."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, places, rows, size = [], [], [], 0

        def full() -> pa.RecordBatch:
            arrays = [pa.array(sources, pa.string()), pa.array(places, pa.int64()), pa.array(rows, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, names=["source", "pos", "cells"])

        for (source, _, inside, _), lines in _Lines(batches).splits():
            if inside is None:
                raise RuntimeError(f"{source} was split in another way than before; it must not change while it is read")
            start, held = None, []
            for pos, separator, line, _ in lines:
                if inside:
                    held += [separator, line]
                else:
                    start, held = pos, [line]
                inside = multi_line and ends_inside(line, inside) if b'"' in line else inside
                if inside or start is None:
                    continue
                cells = cells_of(b"".join(held))
                if cells:
                    sources.append(source)
                    places.append(start)
                    rows.append(cells)
                    size += sum(map(len, held))
                if len(rows) == 4096 or size > 1 << 24:
                    yield full()
                    sources, places, rows, size = [], [], [], 0
        if rows:
            yield full()

    return parse


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, pos, block, part): what a split holds of records that begin or end in another one, or never end."""

    def row(source: str, pos: int, block: int, held: list[bytes]) -> pa.RecordBatch:
        arrays = [pa.array([source]), pa.array([pos], pa.int64()), pa.array([block], pa.int64()), pa.array([b"".join(held)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["source", "pos", "block", "part"])

    for (source, block, inside, start), lines in _Lines(batches).splits():
        held: list[bytes] = []
        foreign = inside
        for pos, separator, line, _ in lines:
            if inside:
                held += [separator, line]
            else:
                start, held, foreign = pos, [line], False
            inside = ends_inside(line, inside) if b'"' in line else inside
            if foreign and not inside:
                yield row(source, start, block, held)
        if inside:
            yield row(source, start, block, held)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [b"".join(p["part"] for p in parts) for parts in batch.column(2).to_pylist()]
        cells = pa.array([cells_of(p) for p in parts], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], names=["source", "pos", "cells"])


class Delimited:
    """Delimited files at a path: their records, and what their first rows look like.

    With `multi_line` quoted cells may hold line breaks; without it every line is a record. Making
    one walks the files once and keeps a row per split.
    """

    def __init__(self, spark: SparkSession, path: str | list[str], multi_line: bool = True):
        self.multi_line = multi_line
        self.lines = text_lines(spark, path)
        self.splits = durable(self.lines.mapInArrow(_summaries(multi_line), SUMMARY_SQL))
        states = F.struct("block", "from_outside", "from_inside", "outside_start", "inside_start")
        # a file has one of these small rows per split
        in_order = self.splits.groupBy("source").agg(F.array_sort(F.collect_list(states)).alias("splits"))
        self.entered = durable(in_order.mapInArrow(_entered, "source string, block bigint, inside boolean, start bigint, leaves boolean"))

    def files(self) -> DataFrame:
        """(source, names, first, second_width, top_width, broken, unclosed): the cells and position of the first row, the widths of the second
        row and of the first line, whether bytes are no UTF-8, and whether quotes are open at the end."""
        ends = self.entered.groupBy("source").agg(F.max_by("leaves", "block").alias("unclosed"))
        heads = self.splits.groupBy("source").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("names", "first", "second_width", "top_width")], F.bool_or("broken").alias("broken")
        )
        return heads.join(ends, "source")

    def _walked(self) -> DataFrame:
        entry = self.entered.select("source", "block", "inside", "start")
        if entry.count() <= BROADCAST_ROWS:
            met = self.lines.join(F.broadcast(entry), ["source", "block"], "left")
        else:
            placed = self.lines.withColumn("_at", F.monotonically_increasing_id())
            met = placed.join(entry.hint("merge"), ["source", "block"], "left").repartition("source", "block").sortWithinPartitions("source", "block", "_at")
        return met.select("source", "block", "value", "valid", "inside", "start")

    def rows(self) -> DataFrame:
        """(source, pos, cells): every row that is not empty, with all its cells, however many."""
        kinds = "source string, pos bigint, cells array<string>"
        walked = self._walked()
        whole = walked.mapInArrow(_parsed(self.multi_line), kinds)
        if not self.multi_line or self.entered.where("leaves").isEmpty():
            return whole
        parts = walked.mapInArrow(_fragments, "source string, pos bigint, block bigint, part binary")
        joined = parts.groupBy("source", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
        return whole.unionByName(durable(joined.mapInArrow(_joined, kinds)).where(F.size("cells") > 0))
