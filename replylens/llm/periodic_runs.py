"""Stretches of words that repeat with a period, found through minimizers at several scales.

A run is a longest stretch of words with smallest period q, at least twice as long as q and
MIN_LENGTH words. Three ways give the lags at which a stretch may repeat:

* Lags below DIRECT are scanned: words are compared with those q places on.
* A scale S = DIRECT, 2 * DIRECT, ... covers the lags from S to 2S - 1. Every window of S words has a
  minimizer, the place of the smallest hash among its stretches of S/4 words, leftmost if equal. Inside a
  run the windows at i and at i + q are equal, so their minimizers lie q apart: pairs of equal
  minimizers at such a distance are seeds. Stretches that repeat themselves with a period of at most S/8 words are
  left out of the choice, so equal ones left are more than S/8 places apart and a minimizer has a bounded
  number of partners, whatever the text. That rule looks at words of the stretch only, so it does not
  break the equality of windows.
* A run whose windows have nothing but such stretches lies in two neighbouring runs of one shorter period
  which touch and are out of step; the lags that bring them into step are computed.

A seed only proposes a lag and a place: words are compared to both sides until they differ, so hashes
decide nothing. Every run is found, and work grows with the words, their scales and the runs.

Cases: null and empty texts have no words and no runs. Very long texts are treated whole, many short ones
together, with separators that equal no word. Rows are independent, so repeated rows have equal
results; among runs of equal length the first, then that with the smallest period is the longest. An empty table gives an
empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import as_bytes

MIN_LENGTH = 12
DIRECT = 64
# words of the texts that are searched together
TOGETHER = 1 << 20
# the least stretch that minimizers hash is a quarter of DIRECT, and no shorter than a run
assert DIRECT // 4 >= MIN_LENGTH

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _primes(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        same = a[at : min(at + step, n)] == b[at : min(at + step, n)]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = at + len(same), step * 2
    return n


class _Found:
    """Runs as (start, length) by period; each is checked to have no smaller period."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.runs: dict[int, set[tuple[int, int]]] = {}

    def add(self, start: int, length: int, q: int, primitive: bool = False) -> None:
        if length < max(MIN_LENGTH, 2 * q) or (start, length) in self.runs.get(q, ()):
            return
        part = self.words[start : start + length]
        # a smaller period of so long a stretch divides q, so q divided by some prime is a period as well
        if not primitive and any((part[q // f :] == part[: length - q // f]).all() for f in _primes(q)):
            return
        self.runs.setdefault(q, set()).add((start, length))

    def seed(self, at: int, q: int) -> int:
        """Extend the equality of the words at `at` and `at + q`; the place where it ends."""
        w = self.words
        end = at + _reach(w[at:], w[at + q :])
        begin = at - _reach(w[:at][::-1], w[: at + q][::-1])
        self.add(begin, end - begin + q, q)
        return end

    def table(self, below: int | None = None) -> np.ndarray:
        """Columns start, length, period, by start, then period; of periods up to `below` if given."""
        rows = [(s, n, q) for q, found in self.runs.items() if below is None or q <= below for s, n in found]
        return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


class _Hashes:
    """Hashes of all stretches of one length, from sums of word values times powers of an odd number."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64))))))
            terms = _mixed(words.astype(np.uint64) + np.uint64(0x1234567)) * self.powers[:n]
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(terms)))

    def of(self, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def _seeds(hashes: _Hashes, found: _Found, scale: int) -> Iterator[tuple[int, int]]:
    """(lag, place) in order for lags from `scale` to twice that: equal minimizers so far apart."""
    n, length = len(found.words), scale // 4
    if n < 2 * scale:
        return
    values = hashes.of(length)
    # stretches inside a run of a short period, which all are known by now, are not chosen
    short = found.table(length // 2)
    short = short[short[:, 1] >= length]
    cover = np.zeros(len(values) + 1, np.int64)
    np.add.at(cover, short[:, 0], 1)
    np.add.at(cover, short[:, 0] + short[:, 1] - length + 1, -1)
    top = np.uint64((1 << 64) - 1)
    # the upper bits order by hash, the lower ones by place
    low = np.uint64((1 << len(values).bit_length()) - 1)
    keys = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    keys[np.cumsum(cover[:-1]) > 0] = top
    least = np.unique(_window_minima(keys, scale - length + 1))
    least = least[least != top]
    at = (least & low).astype(np.int64)
    value = values[at]
    order = np.lexsort((at, value))
    at, value = at[order], value[order]
    lags, begins = [], []
    for ahead in range(1, len(at)):
        gap = at[ahead:] - at[:-ahead]
        same = value[ahead:] == value[:-ahead]
        near = same & (gap < 2 * scale)
        if not near.any():
            break
        kept = np.flatnonzero(near & (gap >= scale))
        lags.append(gap[kept])
        begins.append(at[kept])
    if lags:
        lag, begin = np.concatenate(lags), np.concatenate(begins)
        order = np.lexsort((begin, lag))
        yield from zip(lag[order].tolist(), begin[order].tolist(), strict=True)


def _out_of_step(found: _Found, periods: Iterable[int]) -> None:
    """Runs of lags from DIRECT on that lie in two touching runs of one of the `periods`, at most a quarter of the lag."""
    w = found.words
    for p in periods:
        ordered = sorted(found.runs[p])
        for (first, n), (second, m) in zip(ordered, ordered[1:], strict=False):
            end, last = first + n, second + m
            if second > end or min(n, m) < DIRECT:
                continue
            # where the first unit of the second run begins in the unit of the first run, if it does
            twice, unit = np.concatenate((w[first : first + p],) * 2), w[second : second + p]
            turns = [r for r in np.flatnonzero(twice[:p] == unit[0]).tolist() if (twice[r : r + p] == unit).all()]
            if not turns:
                continue
            lags = np.arange((second - first - turns[0]) % p, min(n, m) + 1, p)
            lags = lags[lags >= max(DIRECT, 4 * p)]
            begins, ends = np.maximum(first, second - lags), np.minimum(end, last - lags)
            fits = ends - begins >= lags
            for q, begin, stop in zip(lags[fits].tolist(), begins[fits].tolist(), ends[fits].tolist(), strict=True):
                # one of the two runs ends first unless both end at the lag's distance
                if first == second - q:
                    begin -= _reach(w[:begin][::-1], w[: begin + q][::-1])
                if end == last - q:
                    stop += _reach(w[stop:], w[stop + q :])
                # out of step, so no shorter period fits
                found.add(begin, stop - begin + q, q, primitive=True)


def periodic_runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """All runs of a sequence of word numbers: rows (start, length, period) by start, then period.

    No run is longer than `longest`, if that is known.
    """
    found, most = _Found(words), len(words) if longest is None else longest
    for q in range(1, min(DIRECT - 1, most // 2) + 1):
        begins, ends = _stretches(words[q:] == words[:-q])
        long = ends - begins >= max(q, MIN_LENGTH - q)
        for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            found.add(begin, end - begin + q, q)
    hashes = _Hashes(words) if most >= 2 * DIRECT else None
    scale = DIRECT
    while hashes and 2 * scale <= most:
        _out_of_step(found, [p for p in found.runs if (0 if scale == DIRECT else scale // 16) < p <= scale // 8])
        lag, done = 0, 0
        for q, at in _seeds(hashes, found, scale):
            if q != lag:
                lag, done = q, 0
            if at >= done:
                done = found.seed(at, q)
        scale *= 2
    return found.table()


def words_of(text: bytes) -> list[bytes]:
    """Words between the six ASCII white space characters."""
    return text.split()


def repeated_tail(words: list, h: int) -> list:
    """The words from a place on replaced by a repetition, as a tenth of the ids (h % 10 = 0) asks for."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _searched(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text; all texts are searched in one sequence with separators between them."""
    numbers: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for i, words in enumerate(texts):
        starts.append(at)
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32))
        parts.append(np.array([-1 - i], np.int32))
        at += len(words) + 1
    runs = periodic_runs(np.concatenate(parts), max(map(len, texts)))
    cuts = np.searchsorted(runs[:, 0], starts + [at])
    return [runs[low:high] - [start, 0, 0] for low, high, start in zip(cuts, cuts[1:], starts, strict=False)]


def kept_words(words: list, runs: np.ndarray) -> list:
    """The words outside all runs, and the first period of runs."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    covered = np.cumsum(change[:-1])
    return words if not covered.any() else [words[i] for i in np.flatnonzero(covered == 0)]


RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def _results(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    runs = _searched(texts)
    collapsed = [b" ".join(kept_words(w, r)) for w, r in zip(texts, runs, strict=True)]
    every = np.concatenate(runs)
    ends = np.cumsum([0] + [len(r) for r in runs]).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], [RUNS.value_type.field(i).name for i in range(3)])
    columns = [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])


def _found_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row of batches with the columns doc_id, h (null: no change) and text."""
    ids: list = []
    held: list[list[bytes]] = []
    size = 0
    for batch in batches:
        for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            words = words_of(text)
            if held and size + len(words) > TOGETHER:
                yield _results(ids, held)
                ids, held, size = [], [], 0
            ids.append(i)
            held.append(words if h is None else repeated_tail(words, h))
            size += len(words)
    if held:
        yield _results(ids, held)


def find_runs(docs: DataFrame, h: Column | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) per row of `docs`: all runs by start and period, and the text with each run cut to its first period.

    `h` is an unsigned hash per row; where it is a multiple of ten the words are first replaced by a
    repetition of their own (`repeated_tail`). Without `h` texts are searched as they are. Collapsed texts have one space
    between words.
    """
    change = F.lit(None) if h is None else h
    chosen = docs.select(F.col("doc_id").cast("bigint"), change.cast("bigint").alias("h"), F.col("text").cast("string"))
    return chosen.mapInArrow(_found_in, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def longest(runs: Column) -> Column:
    """The longest run; of equally long ones the first, then that with the smallest period. Null without runs."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """`start,length,period` and a line feed per run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
