"""Best-fit packing of tokenised documents, improved by a swap-based local search.

A document's ids are followed by an end id; only documents longer than a sequence are cut,
into full pieces and a last one. Full pieces are sequences of their own. The others are dealt
into groups of bounded size by hash; a group is packed by best fit, largest first, and then
improved: a piece moves to a fuller bin, or one or two pieces are exchanged for one, or one for
two, whenever the fuller bin gets fuller still, so the sum of squared fills grows and the
emptiest bins run empty. The emptier half of a group's bins is then dealt again, among fewer groups,
and packed with what other groups had left, until one group remains.

Cases: a null or empty text is its end id alone. Repeated rows are packed each for itself.
A very long text gives many pieces, never a longer one. An empty table gives no pieces. Columns
other than doc_id and text are not read unless carried by name.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from replylens.llm.common import stored

CAPACITY = 4096
END_ID = 1
# pieces per group
GROUP = 4000
# words whose ids a task keeps at hand, in either of two generations
CACHE_WORDS = 600_000
# bytes of text that are tokenized at a time
TEXT_BYTES = 8 << 20
# tokens a bin may lack and still be closed
SLACK = 4

# kinds of bytes: lower-case ASCII letters, ASCII punctuation but the quote, white space, anything else
LETTER, MARK, BLANK = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[[*range(97, 123)]] = LETTER
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = MARK
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
# what special tokens begin with
SPECIAL = b"<|"
# words of small letters, ASCII or Latin-1: they are as they are in normal form and in lower case
LOWER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# byte-level tokenizers write a byte as the character of its number, but for these of the second bytes
BYTE_CHARACTERS = {0x9F: 0x141, 0xA0: 0x142, 0xAD: 0x143}
# such words on which the short way to their ids is tried: every letter, common words and none
PROBE = "abcdefghijklmnopqrstuvwxyz zyxwvutsrqponmlkjihgfedcba ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ the quick brown fox jumps over lazy dogs s t re qxzv été ñesezrr"


def words_of(texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text, A-Z in lower case, between ASCII white space.

    A run of ASCII punctuation after a letter and before white space, a letter or the end is a token's
    edge on both sides for the tokenizer, so it becomes a word of its own here; a quote may begin a contraction and stays. All
    texts are handled as one array of bytes.
    """
    data = b"\n".join(texts).lower() + b"\n"
    codes = np.frombuffer(data, np.uint8)
    kind = KIND[codes]
    letter, mark = kind == LETTER, kind == MARK
    # the second byte of a Latin-1 letter, in lower case
    ends_letter = letter.copy()
    ends_letter[1:] |= (codes[:-1] == 0xC3) & (codes[1:] >= 0xA0) & (codes[1:] <= 0xBF) & (codes[1:] != 0xB7)
    starts = np.flatnonzero(mark & ~np.r_[False, mark[:-1]])
    ends = np.flatnonzero(mark & ~np.r_[mark[1:], False]) + 1
    apart = (starts > 0) & ends_letter[starts - 1] & (letter[ends] | (kind[ends] == BLANK))
    gaps = np.zeros(len(codes), np.int64)
    gaps[starts[apart]] = 1
    gaps[ends[apart & letter[ends]]] = 1
    at = np.arange(len(codes)) + np.cumsum(gaps)
    spaced = np.full(at[-1] + 1, 32, np.uint8)
    spaced[at] = codes
    blob = spaced.tobytes()
    last = np.cumsum([len(t) + 1 for t in texts]) - 1  # places of the line ends that were put between texts
    bounds = at[last].tolist()
    return [blob[low:high].split() for low, high in zip([0, *bounds[:-1]], bounds, strict=True)]


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space, by way of a cache of words.

    Words between ASCII white space are encoded on their own, which gives the ids of the
    whole text because no token crosses white space. A text that may hold special tokens is
    encoded in one piece.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # words of LOWER letters need no normalizing, are split at spaces and come as characters for bytes; any other goes the whole way
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, CharDelimiterSplit(" ")
        probe = PROBE.encode().split()
        self.short = self._letters(probe, False) == self._letters(probe, True) != []
        # words in use, and those that were before the last change of generation
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, text: str, tokenizer: Tokenizer | None = None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode(text, add_special_tokens=False).ids, "<u4")

    def _letters(self, words: list[bytes], short: bool) -> list[bytes]:
        """The ids of words of letters, each of which ends with the first id that ends a word; nothing if these are not as many."""
        text = b" ".join(words)
        if short:
            ids = self._encode(text.decode("latin-1").translate(BYTE_CHARACTERS), self.plain)
        else:
            ids = self._encode(text.decode())
        cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if len(cuts) == len(words) else []

    def _learn(self, missing: set[bytes]) -> None:
        lower = [w for w in missing if w.isalpha() or LOWER.fullmatch(w)] if self.short else []
        for low in range(0, len(lower), 256):
            part = lower[low : low + 256]
            self.cache.update(zip(part, self._letters(part, True), strict=False))
        rest = [w for w in missing if w not in self.cache and w.decode().isalpha()]
        for low in range(0, len(rest), 256):
            part = rest[low : low + 256]
            self.cache.update(zip(part, self._letters(part, False), strict=False))
        for word in missing:
            if word not in self.cache:
                self.cache[word] = self._encode(word.decode()).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not texts:
            return []
        whole = {i for i, t in enumerate(texts) if SPECIAL in t}
        split = words_of([b"" if i in whole else t for i, t in enumerate(texts)])
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        words = list(chain.from_iterable(split))
        ids = list(map(self.cache.get, words))
        gaps = [i for i, found in enumerate(ids) if found is None]
        if gaps:
            missing = {words[i] for i in gaps}
            if self.older:
                self.cache.update((w, self.older[w]) for w in missing if w in self.older)
                missing.difference_update(self.cache)
            self._learn(missing)
            for i in gaps:
                ids[i] = self.cache[words[i]]
        ends = list(accumulate(map(len, split)))
        out = [b"".join(ids[low:high]) for low, high in zip([0, *ends[:-1]], ends, strict=True)]
        for i in whole:
            out[i] = self._encode(texts[i].decode()).tobytes()
        return out


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = "piece int, start long, length long, ids_crc32 long"


def _bounded(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most 256 rows and TEXT_BYTES of text, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if i > low and (i - low == 256 or held + size > TEXT_BYTES):
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield batch.slice(low)


def _pieces(path: str, carry: int, with_ids: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for mapInArrow: one row per piece; the first `carry` columns are kept."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in _bounded(batch, carry):
                texts = [t or b"" for t in part.column(carry).cast(pa.binary()).to_pylist()]
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(tokenizer.encode(texts)):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * CAPACITY)):
                        cut_ids = data[at : at + 4 * CAPACITY]
                        of.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut_ids) // 4)
                        crc.append(zlib.crc32(cut_ids))
                        ids.append(cut_ids)
                columns = [pc.take(part.column(c), pa.array(of, pa.int32())) for c in range(carry)]
                columns += [pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                names = [*part.schema.names[:carry], "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, `carry` and the pieces of each row; `ids` (little-endian 32-bit) on demand."""
    names = ["doc_id", *(carry or [])]
    chosen = docs.select(*names, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_pieces(tokenizer_path, len(names), with_ids), f"{schema}, {PIECES}" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, into the fullest bin with room for it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, number = free.pop(at)
        else:
            room, number = capacity, len(bins)
            bins.append([])
        bins[number].append(item)
        insort(free, (room - size, number))
    return bins


class Bins:
    """Bins of items, of which those that are underfull offer their items for exchange.

    Items of one length are alike, so a bin offers lengths: single ones and pairs, which are at most
    a capacity long and therefore few. All offers stand in two sorted lists.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity, self.lengths = capacity, lengths
        self.items: list[dict[int, list[int]]] = [{} for _ in bins]
        for held, members in zip(self.items, bins, strict=True):
            for i in members:
                held.setdefault(lengths[i], []).append(i)
        self.fill = [sum(lengths[i] for i in members) for members in bins]
        self.alive = sum(1 for f in self.fill if f)
        self.singles: list[tuple] = []
        self.pairs: list[tuple] = []
        self.open = {b for b, f in enumerate(self.fill) if 0 < f < capacity}
        for b in self.open:
            self.singles += self._single(b)
            self.pairs += self._pair(b)
        self.singles.sort()
        self.pairs.sort()

    def _single(self, b: int) -> list[tuple]:
        return [(size, b, (size,)) for size in self.items[b]]

    def _pair(self, b: int) -> list[tuple]:
        sizes = sorted(self.items[b])
        twice = [(2 * s, b, (s, s)) for s in sizes if len(self.items[b][s]) > 1]
        return twice + [(s + t, b, (s, t)) for k, s in enumerate(sizes) for t in sizes[k + 1 :]]

    def _offer(self, b: int, present: bool) -> None:
        for listed, own in ((self.singles, self._single(b)), (self.pairs, self._pair(b))):
            for entry in own:
                if present:
                    insort(listed, entry)
                else:
                    del listed[bisect_left(listed, entry)]

    def exchange(self, target: int) -> tuple[int, tuple, tuple] | None:
        """(bin, lengths it gives, lengths it takes) of the exchange that fills `target` best and raises the sum of squared fills.

        One or two are moved, or given for one; or one is given for two.
        """
        room, fill = self.capacity - self.fill[target], self.fill
        best, chosen = 0, None
        one, two = self._single(target), self._pair(target)
        for offers, returned in ((self.singles, [(0, target, ()), *one, *two]), (self.pairs, [(0, target, ()), *one])):
            for back, _, takes in returned:
                at = bisect_left(offers, (back + room + 1,)) - 1
                while at >= 0 and (gain := offers[at][0] - back) > best:
                    _, source, gives = offers[at]
                    if source != target and fill[target] - fill[source] + gain > 0:
                        best, chosen = gain, (source, gives, takes)
                        break
                    at -= 1
                if best == room:
                    return chosen
        return chosen

    def apply(self, target: int, source: int, gives: tuple, takes: tuple) -> None:
        for b in (target, source):
            self._offer(b, False)
        for giver, receiver, sizes in ((source, target, gives), (target, source, takes)):
            for size in sizes:
                held = self.items[giver][size]
                self.items[receiver].setdefault(size, []).append(held.pop())
                if not held:
                    del self.items[giver][size]
                self.fill[giver] -= size
                self.fill[receiver] += size
        for b in (target, source):
            self.open.discard(b)
            if 0 < self.fill[b] < self.capacity:
                self.open.add(b)
                self._offer(b, True)
        self.alive -= not self.fill[source]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Exchanges between any two underfull bins, each raising the sum of squared fills, until none is left or
    there are as few bins as their content allows. Bins that are emptied go."""
    packed = Bins(bins, lengths, capacity)
    fewest = -(-sum(packed.fill) // capacity)
    improved = True
    while improved and packed.alive > fewest:
        improved = False
        for target in sorted(packed.open, key=lambda b: (-packed.fill[b], b)):
            while target in packed.open and packed.alive > fewest and (found := packed.exchange(target)):
                packed.apply(target, *found)
                improved = True
    return [[i for members in held.values() for i in members] for held in packed.items if held]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def repack(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The items of `bins` packed anew, or the bins as they are if that takes no fewer; improved either way."""
    fresh = best_fit(lengths, capacity)
    return local_search(fresh if len(fresh) < len(bins) else bins, lengths, capacity)


def _pack_group(level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Function for applyInPandas: packs a group and closes its fuller bins, or all if it is the last."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        lengths = rows["length"].tolist()
        bins = [list(members) for members in rows.groupby("sequence_id").indices.values()]
        bins = repack(bins, lengths)
        fills = [sum(lengths[i] for i in members) for members in bins]
        enough = min(CAPACITY - SLACK, sorted(fills)[len(fills) // 2])
        sequence, offset, closed = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for number, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = (level << 56) | (int(key[0]) << 20) | number, at
                at += lengths[i]
            closed[members] = last or at >= enough
        return pd.DataFrame({"uid": rows["uid"], "length": rows["length"], "sequence_id": sequence, "offset": offset, "closed": closed})

    return packed


def assign(items: DataFrame, group: int = GROUP) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid, length), each at most a sequence long.

    At least half of the bins are closed per level, so the levels together handle about twice the items.
    """
    full = items.where(F.col("length") == CAPACITY).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done, level = [full], 1
    rest = items.where(F.col("length") < CAPACITY).select("uid", "length", F.col("uid").alias("sequence_id"))
    while count := rest.count():
        groups = -(-count // group)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)))
        packed = dealt.groupBy("group").applyInPandas(_pack_group(level, groups == 1), "uid long, length long, sequence_id long, offset long, closed boolean")
        packed = stored(packed, f"packed-{level}")
        done.append(packed.where("closed").select("uid", "sequence_id", "offset"))
        rest, level = packed.where("not closed").select("uid", "length", "sequence_id"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows with their sequence and their place in it."""
    numbered = pieces(docs, tokenizer_path, carry, with_ids).withColumn("uid", F.monotonically_increasing_id())
    kept = stored(numbered, "pieces")
    return kept.join(assign(kept.select("uid", "length")).hint("merge"), "uid").drop("uid")
