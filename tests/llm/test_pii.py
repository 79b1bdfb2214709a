"""Plain findings against their patterns, disguised ones against what they stand for."""

import hashlib
import random
import re

import pytest

from replylens.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        total = sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if valid(k, m[0]))


def test_plain_findings():
    chosen = random.Random(5)
    parts = ["1", "2", "25", "0", "4", "9", ".", ".", "@", "a", "b-", "+", "+1", " ", "-", "(", ")", "é", "a@b.c", "1.2.3.4", "4111111111111111", "0" * 9, "٣"]
    for _ in range(20_000):
        text = "".join(chosen.choices(parts, k=chosen.randint(0, 30)))
        assert pii.plain(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write john [at] example [dot] com now", "email:john [at] example [dot] com"),
        ("john at mail dot example dot com", "email:john at mail dot example dot com"),
        ("jоhn@exаmple.com", "email:jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven now", "phone:plus one five five five one two three four five six seven"),
        ("card " + "four" + " one" * 15 + ".", "card:four" + " one" * 15),
        ("192 dot 168 dot 1 dot 20", "ip:192 dot 168 dot 1 dot 20"),
        ("192[.]168[.]1[.]1", "ip:192[.]168[.]1[.]1"),
        ("at １９２．１６８．１．１", "ip:１９２．１６８．１．１"),
        ("4O12 8888 8888 1881", "card:4O12 8888 8888 1881"),
        ("jo​hn@ex\xadample.com", "email:jo​hn@ex\xadample.com"),
        ("user{at}host(dot)org", "email:user{at}host(dot)org"),
        ("john @ example.com", "email:john @ example.com"),
        ("john @_example.com", "email:john @_example.com"),
        ("john at mail.example dot com", "email:john at mail.example dot com"),
        ("+1 5OO5 1234 99", "phone:+1 5OO5 1234 99"),
        ("4111 1111 1111 l111", "card:4111 1111 1111 l111"),
    ],
)
def test_disguised_findings(text, found):
    spans = pii.disguised(text, pii.plain(text))
    assert [f"{pii.KINDS[k]}:{text[a:b]}" for a, k, b in spans] == [found]


@pytest.mark.parametrize("text", ["found at example.com", "look at the dot", "one two three", "seven, eight, nine ate", "I am at home", "0.1.2", "é" * 9, "one dot two"])
def test_ordinary_texts_are_left_alone(text):
    assert pii.plain(text) == pii.disguised(text, []) == []


def test_plain_findings_are_not_found_twice():
    text = "a@b.com and jоe@b.com, +1 (017) 555-7713"
    base = pii.plain(text)
    assert [pii.KINDS[k] for _, k, _ in base] == ["email", "phone"] or len(base) == 3
    assert not {(a, b) for a, _, b in base} & {(a, b) for a, _, b in pii.disguised(text, base)}


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "é a@b.c 1.2.3.4"), (3, "é a@b.c 1.2.3.4"), (None, "x (at) y (dot) z"), (4, "a" * 300_000 + "@b.c " + "1" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 spans", "2 n_email")
    got = sorted(pii.find_pii(docs).collect(), key=lambda r: (r.doc_id or 0, r.spans))
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_email, r.n_ip, r.spans) for r in got] == [
        (None, 0, 0, "email:0:16"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 1, "email:2:7,ip:8:15"), (3, 1, 1, "email:2:7,ip:8:15"), (4, 1, 0, "email:0:300004"),
    ]
    assert [r.base_sha256 == empty for r in got] == [True, True, True, False, False, False] and got[0].n_disguised == 1
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_an_address_in_part_plain_is_reported_whole():
    text = "write jоhn@example.com or 1.2.3.4"
    base = pii.plain(text)
    assert [text[a:b] for a, _, b in base] == ["hn@example.com", "1.2.3.4"]
    more = pii.disguised(text, base)
    assert [text[a:b] for a, _, b in more] == ["jоhn@example.com"]
    assert pii.redacted(text, [*base, *more]) == "write [EMAIL] or [IP]"
    # numbers do not take in spelled ones beside them
    text = "+1 (017) 555-7713 two times"
    assert pii.disguised(text, pii.plain(text)) == []


def test_redaction():
    text = "mail a@b.c or 1.2.3.4!"
    assert pii.redacted(text, pii.plain(text)) == "mail [EMAIL] or [IP]!"
