"""Personal data in plain and in disguised form, with spans of the original text.

Plain identifiers are found by their patterns. For disguised ones two transducers rewrite the
text: characters (homoglyphs, full-width forms, digits of other scripts, invisible characters)
and then words (spelled digits, bracketed or spelled "at" and "dot", letters standing for
digits). Each keeps, per output character, the source span it came from; the identifiers found in
the rewritten text are mapped back through both. A disguised finding counts only if a
rewritten character is part of it and no plain finding of its kind overlaps it.

Cases: a null text is empty and has no findings. Spans count code points, end exclusive.
Long texts are scanned whole, in time linear in their length. Repeated rows are scanned each for
itself; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number can only begin where the run of digits before it ended
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses: the run of local characters before each @ and a domain after it."""
    low = 0
    at = text.find("@")
    while at >= 0:
        before = text[low:at]
        local = len(before) - len(before.rstrip(LOCAL_CHARS))
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def ips(text: str) -> Iterator[Span]:
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in match[0].split(".")):
            yield match.span()


def cards(text: str) -> Iterator[Span]:
    for match in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", match[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[Span]:
    for match in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", match[0])) <= 15:
            yield match.span()


FINDERS: tuple[Callable[[str], Iterator[Span]], ...] = (emails, ips, cards, phones)


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), sorted."""
    return sorted((a, k, b) for k, find in enumerate(FINDERS) for a, b in find(text))


# letters that look like Latin ones, by the Latin letter
LOOKALIKES = {
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "еє", "h": "һ", "i": "іιı", "j": "ј",
    "k": "кκ", "l": "ӏ", "m": "м", "n": "η", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј",
    "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ",
    "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    ".": "。․·", "-": "‐‑‒–—−", "@": "﹫", "+": "﹢",
}
LATIN = {look: latin for latin, looks in LOOKALIKES.items() for look in looks}
INVISIBLE = "­᠎​‌‍‎‏⁠﻿"
# what the character transducer may change: lookalikes, invisible characters, other digits, spaces and full-width forms
ODD = re.compile(f"[{re.escape(''.join(LATIN) + INVISIBLE)}  -  　！-～①-⑳]|(?![0-9])\\d")

DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SPELLED = "|".join(DIGITS)
_TOKEN = rf"(?:{_SPELLED}|[0-9]+)"
_DOT = r"(?:[\x20_-]dot[\x20_-]|[\x20\t]?[\[({<][\x20\t]?(?:dot|\.)[\x20\t]?[\])}>][\x20\t]?)"
WORDS = re.compile(
    rf"(?P<at>[\x20\t]?[\[({{<][\x20\t]?(?:at|@)[\x20\t]?[\])}}>][\x20\t]?)"
    rf"|(?P<dot>[\x20\t]?[\[({{<][\x20\t]?(?:dot|\.)[\x20\t]?[\])}}>][\x20\t]?)"
    # a spelled "at" needs a disguised dot after it: "found at example.com" is no address
    rf"|(?P<spelled>(?<=[A-Za-z0-9])[\x20_-]at[\x20_-](?=(?:[A-Za-z0-9-]+\.)*[A-Za-z0-9-]+{_DOT}[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9])[\x20_-]@[\x20_-](?=[A-Za-z0-9-]+(?:\.|{_DOT})[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9])[\x20_-]dot[\x20_-](?=[A-Za-z0-9]))"
    rf"|(?P<run>(?<![A-Za-z0-9])(?:plus[\x20-])?{_TOKEN}(?:[\x20,-]{{1,2}}{_TOKEN})+(?![A-Za-z0-9]))"
    rf"|(?P<letter>(?:(?<=[0-9])|(?<=[0-9][\x20-]))[OoIl]+(?=[0-9]))",
    re.IGNORECASE,
)
RUN_TOKEN = re.compile(rf"plus[\x20-]|{_SPELLED}", re.IGNORECASE)
# cheap signs that the word transducer may have something to do
SIGNS = ("dot", *(f"{a}@{b}" for a in " _-" for b in " _-"), *(f"{b}{gap}{sign}" for b in "[({<" for gap in ("", " ", "\t") for sign in ("at", "@", ".")))
_SPACED = bytes.maketrans(b",-_", b"   ")
SPELLED_BYTES = {word.encode() for word in DIGITS}
LETTER = re.compile(r"[0-9][\x20-]?[OoIl]+[0-9]")


def may_be_disguised(text: str) -> bool:
    low = text.lower()
    if any(sign in low for sign in SIGNS) or LETTER.search(text):
        return True
    return not SPELLED_BYTES.isdisjoint(low.encode().translate(_SPACED).split())


# an edit of a text: (start, end, what stands there instead)
Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits; maps spans of it back to the text before."""

    def __init__(self, text: str, edits: list[Edit]):
        parts: list[str] = []
        # per piece: where it begins now, where it began and ended, whether it is an edit
        self.begins: list[int] = []
        self.pieces: list[tuple[int, int, bool]] = []
        at = now = 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for low, high, piece, edited in ((at, start, text[at:start], False), (start, end, new, True)):
                if piece:
                    self.begins.append(now)
                    self.pieces.append((low, high, edited))
                    parts.append(piece)
                    now += len(piece)
            at = end
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span before the edits and whether an edit lies in it."""
        first, last = bisect_right(self.begins, start) - 1, bisect_right(self.begins, end - 1) - 1
        low, _, edited = self.pieces[first]
        low = low if edited else low + start - self.begins[first]
        high_low, high, edited_last = self.pieces[last]
        high = high if edited_last else high_low + end - self.begins[last]
        # pieces that touch an edit between them, also one that left nothing
        inside = any(self.pieces[k][2] for k in range(first, last + 1)) or high - low != end - start
        return low, high, inside


def _plain_character(char: str) -> str:
    if char in INVISIBLE:
        return ""
    if char in LATIN:
        return LATIN[char]
    folded = unicodedata.normalize("NFKC", char)
    return str(unicodedata.digit(char)) if len(folded) == 1 and folded.isdigit() and not folded.isascii() else folded


def character_edits(text: str) -> list[Edit]:
    return [] if text.isascii() else [(m.start(), m.end(), _plain_character(m[0])) for m in ODD.finditer(text)]


def word_edits(text: str) -> list[Edit]:
    if not may_be_disguised(text):
        return []
    edits: list[Edit] = []
    for match in WORDS.finditer(text):
        kind, start, end = match.lastgroup, *match.span()
        if kind == "at":
            edits.append((start, end, "@"))
        elif kind == "dot":
            edits.append((start, end, "."))
        elif kind == "spelled":
            edits.append((start, end, "@" if re.search("at|@", match[0], re.IGNORECASE) else "."))
        elif kind == "letter":
            edits.append((start, end, "".join("0" if c in "Oo" else "1" for c in match[0])))
        elif kind == "run" and RUN_TOKEN.search(match[0]):
            # numbers keep their separators; a spelled digit stands alone
            last = None
            for token in RUN_TOKEN.finditer(match[0]):
                a, b = start + token.start(), start + token.end()
                word = token[0].lower()
                if last is not None and not text[last:a].strip(" ,-"):
                    edits.append((last, a, "")) if last < a else None
                edits.append((a, b, "+" if word.startswith("plus") else DIGITS[word]))
                last = b
    return edits


# kinds whose disguised findings may contain plain ones; numbers may just stand beside spelled ones
WHOLE = frozenset({"email", "ip"})


def disguised(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Findings that only show after rewriting, as (start, place of the kind, end) of `text`."""
    by_characters = character_edits(text)
    first = Rewritten(text, by_characters) if by_characters else None
    by_words = word_edits(first.text if first else text)
    second = Rewritten(first.text if first else text, by_words) if by_words else None
    if not first and not second:
        return []
    found = []
    for start, kind, end in plain((second or first).text):
        changed = False
        for step in (second, first):
            if step:
                start, end, edited = step.source(start, end)
                changed |= edited
        if changed:
            found.append((start, kind, end))
    out = []
    for kind in range(len(KINDS)):
        taken = sorted((a, b) for a, k, b in known if k == kind)
        starts = [a for a, _ in taken]
        for start, _, end in (f for f in found if f[1] == kind):
            at = bisect_right(starts, end - 1) - 1
            apart = at < 0 or taken[at][1] <= start
            # an address of which only a part is plain is reported whole, beside that part
            longer = KINDS[kind] in WHOLE and not apart and not (taken[at][0] <= start and end <= taken[at][1])
            if apart or longer:
                out.append((start, kind, end))
    return sorted(out)


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _findings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = plain(text or "")
            more = disguised(text or "", base)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more]), len(more)))
        columns = [batch.column(0)] + [pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else None
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: counts of plain findings, their digest, all spans, and the number of disguised ones."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _findings, f"doc_id long, {counts}, base_sha256 string, spans string, n_disguised long"
    )


def redacted(text: str, spans: Iterable[tuple[int, int, int]]) -> str:
    """The text with each finding replaced by its kind in brackets; overlapping findings are replaced as one."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])
