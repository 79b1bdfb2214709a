"""Means over all pairs of a model's replies, without a pair join.

Distinct items of a group are spread over blocks of bounded size. Every pair of
blocks is one tile, an item is sent to the tiles of its block, and a tile returns
a single partial sum. No row stands for a pair, no task holds a whole group, and
copies of the same item are weighed instead of compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.session import BROADCAST_ROWS, durable, join_bounded

# Texts per block: a tile compares at most twice the square of this.
TEXT_BLOCK = 192
# and bytes of text per block, by the average length
BLOCK_BYTES = 4 << 20
# Points of pairs of texts that are compared together: places at which characters are the same.
POINTS = 1 << 17
# Characters of a tile for which it is noted where they come next.
COLUMNS = 128
# Places times characters in these notes, and in those that are looked up at a time.
CELLS = 1 << 26
ROW_CELLS = 1 << 18
# A place that no text in them has.
NEVER = np.int16(32767)
# Pairs that are compared one by one.
FEW_PAIRS = 100
# Key sets per block: a tile is one matrix product of this size.
KEY_SET_BLOCK = 1024
# A key that at most so many sets of a group have is rare.
RARE_SETS = 1024
# Distinct keys held in one matrix at a time, however many a tile has.
KEY_COLUMNS = 4096
# Replies of a group are weighed in ranges with at most so many texts and about so many rows.
RANGE_TEXTS = 1024
RANGE_ROWS = 1 << 22
# Replies that are ordered among each other at a time.
STEP = 256
# Groups that share the comparisons of a tile.
PART_GROUPS = 1024


def _blocks(items, block_rows: int):
    """Number of blocks for about that many items; it decides balance, not results."""
    return F.greatest(F.ceil(items / F.lit(block_rows)), F.lit(1)).cast("int").alias("_blocks")


def _tile_tasks(sizes: DataFrame) -> int:
    """Partitions for the tiles of all groups: enough for all cores, no more than there are tiles."""
    tiles = F.sum(F.col("_blocks") * (F.col("_blocks") + F.lit(1)) / F.lit(2))
    work = sizes.agg(tiles.alias("tiles")).first()
    spark = sizes.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return max(1, min(most, int(work.tiles or 1)))


def _tiled(items: DataFrame, sizes: DataFrame, keys: Sequence[str], block_of) -> DataFrame:
    """Each item once per tile of its block; `sizes` holds the number of `_blocks` per group."""
    group = list(keys)
    per_group = sizes.select(*group, "_blocks")
    if sizes.count() <= BROADCAST_ROWS:
        per_group = F.broadcast(per_group)
    placed = items.join(per_group, group).withColumn("block", F.pmod(block_of, F.col("_blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    return placed.withColumn("_other", F.explode(others)).select(
        *group,
        F.least("block", "_other").alias("tile_low"),
        F.greatest("block", "_other").alias("tile_high"),
        *[c for c in items.columns if c not in group],
        "block",
    )


def _tile_sums(
    items: DataFrame, sizes: DataFrame, keys: Sequence[str], block_of, kernel: Callable[[pd.DataFrame], float]
) -> DataFrame:
    """Sum `kernel` over all tiles of each group, as `pair_sum`.

    The kernel gets the rows of two blocks (or of one, on the diagonal) with their block in `block`.
    """
    group = list(keys)
    tile = [*group, "tile_low", "tile_high"]

    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[:1][group].reset_index(drop=True)
        return head.assign(pair_sum=kernel(rows))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*group).schema.fields)
    # Tiles are small in bytes and heavy in work, so AQE must not merge them.
    tiled = _tiled(items, sizes, keys, block_of).repartition(_tile_tasks(sizes), *tile)
    sums = tiled.groupBy(*tile).applyInPandas(partial, f"{schema}, pair_sum DOUBLE")
    return sums.groupBy(*group).agg(F.sum("pair_sum").alias("pair_sum"))


def matched_characters(matcher: SequenceMatcher, first: int, second: int) -> int:
    """Characters in matching blocks: what `ratio()` counts, without building the blocks."""
    matched = 0
    open_ranges = [(0, first, 0, second)]
    while open_ranges:
        a_low, a_high, b_low, b_high = open_ranges.pop()
        a, b, size = matcher.find_longest_match(a_low, a_high, b_low, b_high)
        if size:
            matched += size
            if a_low < a and b_low < b:
                open_ranges.append((a_low, a, b_low, b))
            if a + size < a_high and b + size < b_high:
                open_ranges.append((a + size, a_high, b + size, b_high))
    return matched


def _pair_count(n):
    return n * (n - F.lit(1)) / F.lit(2)


class _Range:
    """Replies of one group in order: numbers of texts, and how many replies with one text come before those with another."""

    def __init__(self, texts: int, rows: int):
        self.texts, self.rows = texts, rows
        self.codes: dict[int, int] = {}
        self.counts = np.zeros(texts, np.int64)
        self.weights = np.zeros((texts, texts), np.int64)
        self.size, self.bytes, self.first = 0, 0, None

    def fits(self, hashes: np.ndarray) -> bool:
        return self.size == 0 or (self.size < self.rows and len(self.codes.keys() | set(hashes.tolist())) <= self.texts)

    def add(self, hashes: np.ndarray, first: int, size: int) -> None:
        """Further replies, no more than the range may have texts."""
        kinds, at = np.unique(hashes, return_inverse=True)
        ids = np.array([self.codes.setdefault(h, len(self.codes)) for h in kinds.tolist()])
        own = np.zeros((len(hashes), len(kinds)))
        own[np.arange(len(hashes)), at] = 1
        before = np.cumsum(own, axis=0) - own
        here = own.sum(axis=0).astype(np.int64)
        known = len(self.codes)
        self.weights[:known, ids] += np.outer(self.counts[:known], here)
        self.weights[np.ix_(ids, ids)] += np.rint(before.T @ own).astype(np.int64)
        self.counts[ids] += here
        self.first = first if self.first is None else self.first
        self.size += len(hashes)
        self.bytes += size

    def row(self, group: int) -> pa.RecordBatch:
        known = len(self.codes)
        i, j = np.nonzero(self.weights[:known, :known])
        packed = (list(self.codes), self.counts[:known], i, j, self.weights[i, j])
        arrays = [pa.array([v], pa.int64()) for v in (group, self.first, self.bytes)]
        arrays += [pa.array([v], pa.list_(k)) for v, k in zip(packed, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["gid", "first", "bytes", "hashes", "counts", "i", "j", "w"])


RANGES = "gid bigint, first bigint, bytes bigint, hashes array<bigint>, counts array<bigint>, i array<int>, j array<int>, w array<bigint>"


def _ranged(texts: int, rows: int, step: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (gid, pos, h, bytes) as ranges of a group with few texts each; every row is in one range."""

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, last = _Range(texts, rows), None, None
        for batch in batches:
            gid, pos, h, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(gid):
                continue
            if ((gid[1:] == gid[:-1]) & (pos[1:] == pos[:-1])).any() or last == (gid[0], pos[0]):
                raise ValueError("positions repeat within a group; number the replies first (numbering.run_positions)")
            last = (gid[-1], pos[-1])
            edges = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
            for low, high in zip(edges, edges[1:], strict=False):
                if group is not None and gid[low] != group:
                    yield held.row(group)
                    held = _Range(texts, rows)
                group = int(gid[low])
                for at in range(low, high, step):
                    part = slice(at, min(at + step, high))
                    if not held.fits(h[part]):
                        yield held.row(group)
                        held = _Range(texts, rows)
                    held.add(h[part], int(pos[at]), int(size[part].sum()))
        if held.size:
            yield held.row(group)

    return ranges


def _dealt(blocks: int, parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The weights of ranges, dealt over the tiles of their pairs of texts."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes, i, j, w = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("hashes", "i", "j", "w"))
                gid = batch.column("gid")[row].as_py()
                block = hashes % blocks
                tile = np.minimum(block[i], block[j]) * blocks + np.maximum(block[i], block[j])
                order = np.argsort(tile, kind="stable")
                i, j, w, tile = i[order], j[order], w[order], tile[order]
                starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else np.array([], np.int64)
                offsets = pa.array(np.r_[starts, len(tile)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (hashes[i], hashes[j], w)]
                low, high = tile[starts] // blocks, tile[starts] % blocks
                heads = [pa.array(v.astype(np.int32)) for v in (low, high, np.full(len(starts), gid % parts))]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(np.full(len(starts), gid)), *lists], names=["tile_low", "tile_high", "part", "gid", "hi", "hj", "w"])

    return deal


class _Tile:
    """The texts of two blocks with the places of their groups' replies."""

    def __init__(self, texts: pd.DataFrame, within: pd.DataFrame):
        texts = texts.sort_values("h", ignore_index=True)
        self.hashes, self.words, self.blocks = texts["h"].to_numpy(np.int64), texts["text"].tolist(), texts["block"].to_numpy()
        self.diagonal = texts["tile_low"].iat[0] == texts["tile_high"].iat[0]
        lengths = [len(g) for g in texts["gids"]]
        self.of = np.repeat(np.arange(len(texts)), lengths)
        self.gids, self.firsts, self.counts = (np.concatenate([np.asarray(v, np.int64) for v in texts[c]]) for c in ("gids", "firsts", "counts"))
        order = np.lexsort((self.firsts, self.gids))
        self.of, self.gids, self.firsts, self.counts = self.of[order], self.gids[order], self.firsts[order], self.counts[order]
        self.within = dict(iter(within.groupby("gid"))) if len(within) else {}
        self.starts = np.flatnonzero(np.r_[True, self.gids[1:] != self.gids[:-1]])

    def groups(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per group its number, its texts, their numbers of replies, and the weights of their ordered pairs."""
        for low, high in zip(self.starts, np.r_[self.starts[1:], len(self.gids)], strict=True):
            gid = int(self.gids[low])
            present, at = np.unique(self.of[low:high], return_inverse=True)
            firsts, n = self.firsts[low:high], self.counts[low:high]
            ranges = np.cumsum(np.r_[False, firsts[1:] != firsts[:-1]])
            weights = np.zeros((len(present), len(present)), np.int64)
            before = np.zeros(len(present), np.int64)
            # whole ranges come one after the other
            for start in range(0, ranges[-1] + 1, 1024):
                inside = (ranges >= start) & (ranges < start + 1024)
                table = np.zeros((int(ranges[inside].max()) - start + 1, len(present)), np.int64)
                table[ranges[inside] - start, at[inside]] = n[inside]
                weights += (np.cumsum(table, axis=0) - table + before).T @ table
                before += table.sum(axis=0)
            for row in self.within[gid].itertuples(index=False) if gid in self.within else ():
                i, j = (np.searchsorted(present, np.searchsorted(self.hashes, np.asarray(v, np.int64))) for v in (row.hi, row.hj))
                np.add.at(weights, (i, j), np.asarray(row.w, np.int64))
            np.fill_diagonal(weights, 0)
            if not self.diagonal:
                weights[self.blocks[present][:, None] == self.blocks[present][None, :]] = 0
            yield gid, present, before, weights

    def sums(self, similarity: Callable[[list[str], np.ndarray], np.ndarray]) -> pd.DataFrame:
        """Per group the weighted sum of the similarity of its pairs; each pair of texts is compared once for all groups."""
        wanted = np.zeros((len(self.words),) * 2, bool)
        for _, present, _, weights in self.groups():
            wanted[np.ix_(present, present)] |= weights > 0
        alike = similarity(self.words, wanted)
        out = []
        for gid, present, counts, weights in self.groups():
            total = float((alike[np.ix_(present, present)] * weights).sum())
            if self.diagonal:  # a text is similar to itself by exactly 1
                total += float((counts.astype(float) * (counts - 1) / 2).sum())
            out.append((gid, total))
        return pd.DataFrame(out, columns=["gid", "pair_sum"])


def _slices(values: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Parts of an array, one after the other."""
    n = highs - lows
    return values[np.arange(n.sum()) + np.repeat(lows - np.cumsum(n) + n, n)]


class _Matches:
    """Characters in matching blocks of many pairs of texts at once, as `matched_characters` finds them.

    All texts lie in one array of character numbers, each after a gap, and places are places there. `difflib` leaves out characters that are too
    frequent in a second text; `listed` says of each place whether it is left in. A block is found by its row of listed characters that
    both texts have, and goes on into what is left out. Ranges of a pair's texts are split at their longest blocks, all ranges of one depth together.

    Rows of two characters and more are few, so they are listed as points: a place in the first text and one in the second at which a row ends.
    What they leave has only single characters in common, and its blocks follow each other from the left: `following` has for each place where each
    character comes next. Texts too long for that list single characters as points too.
    """

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes, kinds = pd.factorize(letters)
        self.kinds, self.lengths = len(kinds), np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths
        places = np.arange(len(codes)) + np.repeat(np.arange(1, len(words) + 1), self.lengths)
        size = len(codes) + len(words) + 1
        self.codes, self.listed = np.full(size, self.kinds, np.int32), np.zeros(size, bool)
        self.codes[places] = codes
        # places fit into this
        self.kind = np.int32 if size < 1 << 31 else np.int64
        # how often a text has a character, and whether it is left in if the text is second
        self.counts = np.array([np.bincount(self.codes[a : a + n], minlength=self.kinds + 1) for a, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True)], np.int32)
        self.kept = (self.counts > 0) & ((self.counts <= self.lengths[:, None] // 100 + 1) | (self.lengths[:, None] < 200))
        self.text_of = np.repeat(np.arange(len(words) + 1), np.r_[self.lengths + 1, 1]).astype(self.kind)
        self.listed[:-1] = self.kept[self.text_of[:-1], self.codes[:-1]]
        # points of single characters; it decides how pairs are compared, not what comes out
        self.common = self.counts.astype(np.float32) @ (self.counts * self.kept).astype(np.float32).T
        # characters, and those with the one before
        twos = self.codes[:-1].astype(np.int64) * (self.kinds + 1) + self.codes[1:]
        self.grams = {1: self.codes, 2: np.r_[0, pd.factorize(twos)[0] + 1].astype(np.int32)}
        self.heads = {1: self.listed, 2: np.r_[False, self.listed[1:] & self.listed[:-1]]}
        self._follow()

    def _follow(self) -> None:
        """Per place and character the next place of that character in the same text, from the text's beginning, or NEVER.

        The texts' rows for one place lie beside each other, longer texts first. `single` says of two texts whether the blocks of single characters
        can be found there: both are in it, and so is each character that both have.
        """
        has = self.counts > 0
        order = np.argsort(-has[:, :-1].sum(axis=0), kind="stable")
        columns, others = order[:COLUMNS], order[COLUMNS:]
        self.column = np.full(self.kinds + 1, len(columns), np.int32)
        self.column[columns] = np.arange(len(columns))
        by_length = np.argsort(self.lengths, kind="stable")
        fits = (np.cumsum(self.lengths[by_length]) * max(1, len(columns)) <= CELLS) & (self.lengths[by_length] < NEVER)
        rows = by_length[fits][::-1]
        self.rank = np.full(len(self.lengths), -1)
        self.rank[rows] = np.arange(len(rows))
        apart = has[:, others].astype(np.float32) @ self.kept[:, others].T.astype(np.float32) == 0
        tabled = self.rank >= 0
        self.single = tabled[:, None] & tabled & apart
        self.left_in = np.ascontiguousarray(self.kept[:, columns])

        lengths, starts = self.lengths[rows], self.starts[rows]
        longest = int(lengths.max(initial=0))
        # how many texts have a place
        upto = np.searchsorted(-lengths, -np.arange(longest), side="left")
        self.rows = np.cumsum(np.r_[0, upto])
        self.following = np.empty((int(self.rows[-1]), len(columns) + 1), np.int16)
        later, before, lines = np.empty((0, len(columns) + 1), np.int16), 0, np.arange(len(rows))
        for place in range(longest - 1, -1, -1):
            n, low = int(upto[place]), int(self.rows[place])
            now = self.following[low : low + n]
            now[:before], now[before:] = later, NEVER
            now[lines[:n], self.column[self.codes[starts[:n] + place]]] = place
            later, before = now, n

    def points(self, first: np.ndarray, second: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs' texts, numbers of points and points, in order of pair and place, some pairs at a time; the pairs come in order of the second text and the first.

        Second texts with few rows in common with others look them up among the rows of all texts at once; for another one each of its first texts is looked through.
        """
        grams, size = self.grams[least], len(self.codes)
        places = np.argsort(grams, kind="stable").astype(self.kind)
        begins = np.cumsum(np.r_[0, np.bincount(grams)])
        heads = np.flatnonzero(self.heads[least])
        heads = heads[np.bincount(second, minlength=len(self.lengths))[self.text_of[heads]] > 0].astype(self.kind)
        texts = self.text_of[heads]
        met = np.diff(begins)[grams[heads]]
        meets = np.bincount(texts, met, len(self.lengths))
        rare = meets <= np.minimum(np.bincount(second, self.lengths[first], len(self.lengths)), POINTS)

        one, other = first[rare[second]], second[rare[second]]
        number = np.full((len(self.lengths),) * 2, -1, np.int32)
        number[one, other] = np.arange(len(one))
        heads_, texts_, met = (v[rare[texts]] for v in (heads, texts, met))
        part = np.cumsum(meets * rare) // POINTS
        for n in np.unique(part[other]).tolist():
            low, high = np.searchsorted(part[other], (n, n + 1))
            own = slice(*np.searchsorted(part[texts_], (n, n + 1)))
            i, j = _slices(places, begins[grams[heads_[own]]], begins[grams[heads_[own]] + 1]), np.repeat(heads_[own], met[own])
            pair = number[self.text_of[i], self.text_of[j]]
            some = np.flatnonzero(pair >= 0)
            pair, i, j = pair[some], i[some], j[some]
            order = np.argsort(pair.astype(np.int64) * size + i, kind="stable")
            yield one[low:high], other[low:high], np.bincount(pair - low, minlength=high - low), i[order], j[order]

        for text in np.flatnonzero(~rare).tolist():
            own = heads[slice(*np.searchsorted(texts, (text, text + 1)))]
            one = first[slice(*np.searchsorted(second, (text, text + 1)))]
            yield from self._points(one, text, own[np.argsort(grams[own], kind="stable")], grams)

    def _points(self, texts: np.ndarray, second: int, own: np.ndarray, grams: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The same for one second text, whose rows' places come in order of the rows."""
        counts = np.bincount(grams[own], minlength=int(grams.max()) + 1)
        begins = np.cumsum(counts) - counts
        starts, lengths = self.starts[texts], self.lengths[texts]
        at = _slices(grams, starts, starts + lengths)
        inside = np.flatnonzero((counts > 0).take(at))
        at = at[inside]
        each, ends = counts[at], np.cumsum(lengths)
        bounds, upto = np.searchsorted(inside, np.r_[0, ends]), np.cumsum(np.r_[0, each])
        sizes = np.diff(upto[bounds])
        low = 0
        while low < len(texts):
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), POINTS, side="right")))
            part = slice(bounds[low], bounds[high])
            n = each[part]
            i = inside[part] + np.repeat((starts - ends + lengths)[low:high], np.diff(bounds[low : high + 1]))
            nth = np.arange(n.sum()) - np.repeat(upto[part] - upto[bounds[low]] - begins[at[part]], n)
            yield texts[low:high], np.full(high - low, second), sizes[low:high], np.repeat(i.astype(self.kind), n), own[nth]
            low = high

    def count(self, first: np.ndarray, second: np.ndarray, held: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
        """Matching characters per pair; the points of rows of `least` characters come in order of pair and place, `held` of them per pair."""
        a_low, b_low = self.starts[first].astype(self.kind), self.starts[second].astype(self.kind)
        a_high, b_high = a_low + self.lengths[first].astype(self.kind), b_low + self.lengths[second].astype(self.kind)
        of, matched, rest = np.arange(len(first)), np.zeros(len(first), np.int64), []
        run = self._runs(i, j, least)
        while len(of):
            edges = np.cumsum(held) - held
            inside = np.minimum(run, np.minimum(i - np.repeat(a_low, held), j - np.repeat(b_low, held)) + 1)
            longest = np.zeros(len(of), self.kind)
            full = held > 0
            if full.any():
                longest[full] = np.maximum.reduceat(inside, edges[full])
            whole = longest < least
            rest.append([v[whole] for v in (of, a_low, a_high, b_low, b_high)])
            if whole.any():
                stays = np.repeat(~whole, held)
                i, j, run, inside = i[stays], j[stays], run[stays], inside[stays]
                of, a_low, a_high, b_low, b_high, held, longest = (v[~whole] for v in (of, a_low, a_high, b_low, b_high, held, longest))
                if not len(of):
                    break
                edges = np.cumsum(held) - held
            ends = np.flatnonzero(inside == np.repeat(longest, held))
            ends = ends[np.searchsorted(ends, edges)]
            a, b, a_end, b_end = self._block(i[ends] - longest + 1, j[ends] - longest + 1, longest, a_low, a_high, b_low, b_high)
            matched += np.bincount(of, a_end - a, len(matched)).astype(np.int64)

            left = (i < np.repeat(a, held)) & (j < np.repeat(b, held))
            right = (i >= np.repeat(a_end, held)) & (j >= np.repeat(b_end, held))
            halves = [np.add.reduceat(side, edges, dtype=np.int64) for side in (left, right)]
            stays = left | right
            i, j, run = i[stays], j[stays], run[stays]
            held = np.stack(halves, 1).ravel()
            of = np.repeat(of, 2)
            a_low, a_high = np.stack([a_low, a_end], 1).ravel(), np.stack([a, a_high], 1).ravel()
            b_low, b_high = np.stack([b_low, b_end], 1).ravel(), np.stack([b, b_high], 1).ravel()
            left_over = (a_low < a_high) & (b_low < b_high)
            of, a_low, a_high, b_low, b_high, held = (v[left_over] for v in (of, a_low, a_high, b_low, b_high, held))
        of, a_low, a_high, b_low, b_high = (np.concatenate(v) for v in zip(*rest, strict=True))
        if least == 1:
            # without points only the ranges' common beginning is a block
            sizes = self._ahead(a_low, b_low, a_high, b_high)
            return matched + np.bincount(of, sizes, len(matched)).astype(np.int64)
        step = max(1, ROW_CELLS // self.following.shape[1])
        for low in range(0, len(of), step):
            part = slice(low, low + step)
            self._singles(matched, first, second, *(v[part] for v in (of, a_low, a_high, b_low, b_high)))
        return matched

    def _singles(self, matched: np.ndarray, first: np.ndarray, second: np.ndarray, of: np.ndarray, a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> None:
        """Adds the blocks of ranges that have only single characters in common: each holds the first such character from the left."""
        while len(of):
            a_text, b_text = first[of], second[of]
            a_start, b_start = self.starts[a_text], self.starts[b_text]
            next_b = self.following.take(self.rows[b_low - b_start] + self.rank[b_text], axis=0)[:, :-1]
            common = next_b < (b_high - b_start).astype(np.int16)[:, None]
            common &= self.left_in.take(b_text, axis=0)
            next_a = np.where(common, self.following.take(self.rows[a_low - a_start] + self.rank[a_text], axis=0)[:, :-1], NEVER)
            letter, lines = next_a.argmin(axis=1), np.arange(len(of))
            i, j = next_a[lines, letter] + a_start, next_b[lines, letter] + b_start
            found = i < a_high
            # in what lies left of it only the beginning is a block, as it is without a common character
            i, j = np.where(found, i, a_high), np.where(found, j, b_high)
            a, b, a_end, b_end = self._block(i, j, found, a_low, a_high, b_low, b_high, found)
            sizes = a_end - a + self._ahead(a_low, b_low, a, b)
            matched += np.bincount(of, sizes, len(matched)).astype(np.int64)
            more = found & (a_end < a_high) & (b_end < b_high)
            of, a_low, a_high, b_low, b_high = (v[more] for v in (of, a_end, a_high, b_end, b_high))

    def _block(
        self, a: np.ndarray, b: np.ndarray, size: np.ndarray, a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray, found: np.ndarray | bool = True
    ) -> tuple[np.ndarray, ...]:
        """Where blocks begin and end in both texts, which go on as long as characters are the same."""
        a_end, b_end = a + size, b + size
        back = self._same(a - 1, b - 1, np.minimum(a - a_low, b - b_low) * found, -1)
        more = self._ahead(a_end, b_end, a_high, b_high)
        return a - back, b - back, a_end + more, b_end + more

    def _runs(self, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
        """Per point how many listed characters are the same up to it, at least `least`."""
        run = np.full(len(i), least, i.dtype)
        going, n = np.arange(len(i)), least
        while len(going):
            a, b = i[going] - n, j[going] - n
            going = going[(self.codes[a] == self.codes[b]) & self.listed[b]]
            n += 1
            run[going] = n
        return run

    def _ahead(self, a: np.ndarray, b: np.ndarray, a_high: np.ndarray, b_high: np.ndarray) -> np.ndarray:
        """How many characters from two places on are the same."""
        return self._same(a, b, np.minimum(a_high - a, b_high - b), 1)

    def _same(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        found = np.zeros(len(a), self.kind)
        going, n = np.flatnonzero(most > 0), 0
        while len(going):
            going = going[self.codes[a[going] + step * n] == self.codes[b[going] + step * n]]
            n += 1
            found[going] = n
            going = going[most[going] > n]
        return found


def ratios(words: list[str], wanted: np.ndarray) -> np.ndarray:
    """Matching characters of ordered pairs of texts; it depends on which text comes first.

    Pairs are compared together, as many as have about POINTS points. One with more single characters in common goes through `difflib`,
    as do a few pairs for which arrays are not worth their while.
    """
    alike = np.zeros(wanted.shape)
    second, first = np.nonzero(wanted.T)
    if len(first) <= FEW_PAIRS:
        _compare_alone(words, first, second, alike)
        return alike
    matches = _Matches(words)
    alone = matches.common[first, second] > POINTS
    _compare_alone(words, first[alone], second[alone], alike)
    single = matches.single[first, second]

    def compare(held: list[tuple[np.ndarray, ...]], least: int) -> None:
        one, other, sizes, i, j = (np.concatenate(v) for v in zip(*held, strict=True))
        alike[one, other] = 2.0 * matches.count(one, other, sizes, i, j, least) / (matches.lengths[one] + matches.lengths[other])

    for least, some in ((2, ~alone & single), (1, ~alone & ~single)):
        held, size = [], 0
        for found in matches.points(first[some], second[some], least):
            if held and size + len(found[-1]) > POINTS:
                compare(held, least)
                held, size = [], 0
            held.append(found)
            size += len(found[-1])
        if held:
            compare(held, least)
    return alike


def _compare_alone(words: list[str], first: np.ndarray, second: np.ndarray, alike: np.ndarray) -> None:
    """Pairs in order of the second text, one by one."""
    matcher, last = None, None
    for one, other in zip(first.tolist(), second.tolist(), strict=True):
        if other != last:
            matcher, last = SequenceMatcher(None, "", words[other]), other  # keeps its index of the later text
        matcher.set_seq1(words[one])
        alike[one, other] = 2.0 * matched_characters(matcher, len(words[one]), len(words[other])) / (len(words[one]) + len(words[other]))


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two texts, a column of the table at a time as bits."""
    if len(a) < len(b):
        a, b = b, a
    low = 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    end = 0
    while end < len(b) - low and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, letter in enumerate(b):
        places[letter] = places.get(letter, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, distance = full, 0, len(b)
    for letter in a:
        equal = places.get(letter, 0)
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        up, down = (minus | ~(zero | plus)) & full, zero & plus
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = (down | ~(zero | up)) & full, zero & up
    return distance


def edit_similarities(words: list[str], wanted: np.ndarray) -> np.ndarray:
    """1 - edit distance / length of the longer text, which is the same in both orders."""
    alike = np.zeros(wanted.shape)
    pairs = np.triu(wanted | wanted.T, 1)
    for i, j in np.argwhere(pairs).tolist():
        longer = max(len(words[i]), len(words[j]))
        alike[i, j] = alike[j, i] = 1 - edit_distance(words[i], words[j]) / longer
    return alike


SIMILARITIES = {"exact": ratios, "levenshtein": edit_similarities}


def format_consistency(replies: DataFrame, keys: Sequence[str] = ("model",), text: str = "response", mode: str = "exact") -> DataFrame:
    """Mean similarity of all pairs of replies per group, 0 below two replies.

    `mode` is "exact" (matching characters, as `difflib` counts them) or "levenshtein" (1 - edit distance / length of the longer
    text). `replies` needs a position `pos`, unique within the group; a repeat is refused.

    The replies' places, without their texts, are sorted once by ranges. A task turns its replies into ranges with few texts and
    weighs the pairs of texts in each: how many replies with one come before those with the other. Distinct texts of all
    groups then meet in tiles; a pair of texts is compared once for up to PART_GROUPS groups, however long the log is,
    and its similarity is weighed for each group: within ranges by those weights, which go to one tile each, between ranges by the
    numbers of replies alone.
    """
    group = list(keys)
    gid = F.xxhash64(*[F.col(f"`{k}`") for k in group]).alias("gid")
    present = replies.filter(F.col(text).isNotNull())
    narrow = present.select(gid, F.col("pos").cast("bigint").alias("pos"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("bigint").alias("bytes"))
    spark = replies.sparkSession
    # a number of partitions that is given is kept: these rows are few bytes and much work
    ranged = narrow.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "gid", "pos").sortWithinPartitions("gid", "pos")
    ranges = durable(ranged.mapInArrow(_ranged(RANGE_TEXTS, RANGE_ROWS, STEP), RANGES))

    seen = ranges.select("gid", "first", F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select("gid", "first", F.col("x.hashes").alias("h"), F.col("x.counts").alias("n"))
    sizes = durable(seen.groupBy("gid").agg(F.sum("n").alias("_n")))
    occurring = durable(
        seen.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("gid", "first", "n"))).alias("at"))
        .select("h", F.col("at.gid").alias("gids"), F.col("at.first").alias("firsts"), F.col("at.n").alias("counts"))
    )
    distinct = occurring.count()
    total = ranges.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    work = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("n")).first()
    average = total / max(1, work["n"] or 0)
    blocks = max(1, -(-distinct // TEXT_BLOCK), int(distinct * average / BLOCK_BYTES))
    parts = max(1, -(-work["groups"] // PART_GROUPS))
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(most, blocks * (blocks + 1) // 2 * parts))

    tile = ["tile_low", "tile_high", "part"]
    within = ranges.select("gid", "hashes", "i", "j", "w").mapInArrow(
        _dealt(blocks, parts), "tile_low int, tile_high int, part int, gid bigint, hi array<bigint>, hj array<bigint>, w array<bigint>"
    )
    texts = present.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).distinct().join(occurring.hint("merge"), "h")
    block, other = F.pmod("h", F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = texts.withColumn("block", block).withColumn("other", other).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if parts > 1:
        mine = F.filter(F.arrays_zip("gids", "firsts", "counts"), lambda x: F.pmod(x["gids"], F.lit(parts)) == F.col("part"))
        placed = placed.withColumn("mine", mine).where(F.size("mine") > 0)
        placed = placed.select("h", "text", "block", "other", "part", *[F.col(f"mine.{c}").alias(c) for c in ("gids", "firsts", "counts")])
    placed = placed.withColumns({"tile_low": F.least("block", "other"), "tile_high": F.greatest("block", "other")}).drop("other")
    similarity = SIMILARITIES[mode]

    def compared(texts: pd.DataFrame, within: pd.DataFrame) -> pd.DataFrame:
        return _Tile(texts, within).sums(similarity) if len(texts) else pd.DataFrame({"gid": [], "pair_sum": []})

    # tiles are small in bytes and heavy in work, so AQE must not merge them
    sides = [side.repartition(tasks, *tile).groupBy(*tile) for side in (placed, within)]
    sums = sides[0].cogroup(sides[1]).applyInPandas(compared, "gid bigint, pair_sum double").groupBy("gid").agg(F.sum("pair_sum").alias("pair_sum"))
    mean = F.coalesce(F.try_divide("pair_sum", _pair_count(F.col("_n"))), F.lit(0.0))
    # one row per group from here on
    means = sizes.join(sums, "gid", "left").select("gid", mean.alias("format_consistency"))
    named = present.select(*group, gid).distinct()
    return named.join(means, "gid").select(*group, "format_consistency")


def _shared_keys(first: pd.Series, second: pd.Series) -> np.ndarray:
    """Number of common keys of every set in `first` with every set in `second`."""
    codes: dict[str, int] = {}
    sides = []
    for side in (first, second):
        rows = np.repeat(np.arange(len(side)), [len(keys) for keys in side])
        columns = np.array([codes.setdefault(k, len(codes)) for keys in side for k in keys], dtype=np.int64)
        sides.append((rows, columns, len(side)))
    shared = np.zeros((len(first), len(second)))
    for start in range(0, len(codes), KEY_COLUMNS):
        parts = []
        for rows, columns, n in sides:
            inside = (columns >= start) & (columns < start + KEY_COLUMNS)
            part = np.zeros((n, min(KEY_COLUMNS, len(codes) - start)))
            part[rows[inside], columns[inside] - start] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    return shared


def _class_kernel(rows: pd.DataFrame) -> float:
    """Over the ordered pairs of classes of one tile: the Jaccard index by their frequent keys, by their numbers of replies."""
    low, high = rows["tile_low"].iat[0], rows["tile_high"].iat[0]
    first, second = rows[rows["block"] == low], rows[rows["block"] == high]
    if len(first) == 0 or len(second) == 0:
        return 0.0
    shared = _shared_keys(first["pattern"], second["pattern"])
    sizes = [side["size"].to_numpy(dtype=float) for side in (first, second)]
    copies = [side["copies"].to_numpy(dtype=float) for side in (first, second)]
    total = float(copies[0] @ (shared / (sizes[0][:, None] + sizes[1][None, :] - shared)) @ copies[1])
    return total if low == high else 2 * total


def _met(rows: list[dict]) -> float:
    """Over the pairs of sets with one rare key that share no rare key before it: what their rare keys add to the index."""
    key = rows[0]["key"]
    rare = pd.Series([r["rare"] for r in rows])
    earlier = _shared_keys(*[rare.map(lambda keys: [k for k in keys if k < key])] * 2)
    more, pattern = _shared_keys(rare, rare), pd.Series([r["pattern"] for r in rows])
    frequent = _shared_keys(pattern, pattern)
    size, copies = (np.array([r[c] for r in rows], float) for c in ("size", "copies"))
    both = size[:, None] + size[None, :]
    added = (frequent + more) / (both - frequent - more) - frequent / (both - frequent)
    added[earlier > 0] = 0
    np.fill_diagonal(added, 0)
    return float(copies @ added @ copies) / 2


def _rare_sums(keys: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows with `keys` group columns and a rare key, as one sum per group and key; a key has few rows."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            head = [pa.array([held[0][n]], schema.field(n).type) for n in schema.names[:keys]]
            return pa.RecordBatch.from_arrays([*head, pa.array([_met(held)])], names=[*schema.names[:keys], "added"])

        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                if held and any(row[n] != held[0][n] for n in schema.names[: keys + 1]):
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    return sums


def structure_consistency(
    key_sets: DataFrame, keys: Sequence[str] = ("model",), replies: str | None = None
) -> DataFrame:
    """Mean Jaccard index of top-level key sets over all pairs of JSON replies.

    Takes rows with `json_keys`, one per reply or, with `replies` naming a count
    column, one per distinct set of a stored table. Rows without keys are ignored; groups with
    fewer than two JSON replies get 0.

    Keys are told apart by the number of sets that have them. By frequent keys alone the index of two sets depends on which of these they
    have and on their sizes, so it is summed over classes of sets that agree in both. A rare key lists its
    sets, at most RARE_SETS, and what rare keys add to the index of a pair is counted at the first one that both share. Sets
    without a common key never meet.
    """
    group = list(keys)
    weight = F.col(replies) if replies else F.lit(1)
    present = key_sets.filter(F.col("json_keys").isNotNull()).withColumn("json_keys", F.array_sort(F.array_distinct("json_keys")))
    sets = durable(present.groupBy(*group, "json_keys").agg(F.sum(weight).alias("copies")))
    listed = sets.select(*group, "json_keys", F.explode("json_keys").alias("key"))
    spread = listed.groupBy(*group, "key").agg(F.count(F.lit(1)).alias("_sets")).where("_sets > 1")
    spread = durable(spread.select(*group, "key", (F.col("_sets") > RARE_SETS).alias("frequent")))

    # each set with its frequent keys, and those rare ones that another set has as well
    told = join_bounded(listed, spread, [*group, "key"]).groupBy(*group, "json_keys").agg(
        F.array_sort(F.collect_list(F.when(F.col("frequent"), F.col("key")))).alias("pattern"),
        F.array_sort(F.collect_list(F.when(~F.col("frequent"), F.col("key")))).alias("rare"),
    )
    none = F.lit([]).cast("array<string>")
    split = durable(
        sets.join(told, [*group, "json_keys"], "left")
        .select(*group, F.size("json_keys").alias("size"), "copies", F.coalesce("pattern", none).alias("pattern"), F.coalesce("rare", none).alias("rare"))
    )
    copies = F.col("copies").cast("double")
    own = F.sum(copies * copies * F.size("pattern") / (2 * F.col("size") - F.size("pattern")))
    same = F.sum(copies * (copies - 1) / 2)
    totals = durable(split.groupBy(*group).agg(F.sum("copies").alias("_n"), own.alias("_own"), same.alias("_same")))
    classes = durable(split.groupBy(*group, "pattern", "size").agg(F.sum("copies").alias("copies")).where(F.size("pattern") > 0))
    sizes = durable(classes.groupBy(*group).agg(_blocks(F.count(F.lit(1)), KEY_SET_BLOCK)))
    by_class = _tile_sums(classes, sizes, group, F.xxhash64("pattern", "size"), _class_kernel)

    postings = split.where(F.size("rare") > 0).select(*group, F.explode("rare").alias("key"), "size", "copies", "pattern", "rare")
    in_order = postings.repartition(*group, "key").sortWithinPartitions(*group, "key")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.select(*group).schema.fields)
    added = in_order.mapInArrow(_rare_sums(len(group)), f"{kinds}, added double").groupBy(*group).agg(F.sum("added").alias("added"))
    joined = totals.join(by_class, group, "left").join(added, group, "left").fillna(0.0, ["pair_sum", "added"])
    total = F.col("_same") + (F.col("pair_sum") - F.col("_own")) / 2 + F.col("added")
    mean = F.coalesce(F.try_divide(total, _pair_count(F.col("_n"))), F.lit(0.0))
    return joined.select(*group, mean.alias("json_structure_consistency"))


def pair_counts(replies: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Number of unordered pairs per group, from the group's size alone."""
    counted = replies.groupBy(*keys).agg(F.count(F.lit(1)).alias("replies"))
    return counted.withColumn("pairs", F.floor(_pair_count(F.col("replies"))).cast("bigint"))
