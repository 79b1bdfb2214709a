"""Archives by round trip, page texts against the pages' own marks."""

import hashlib
import html
import random
import re
import time
from collections import Counter

import pytest

from replylens.llm import html_text, warc
from replylens.llm.common import scratch_path

LONG = "é" * 600
ROWS = [
    (1, "http://a/", LONG), (5, "http://b/%0A\n", LONG), (3, None, LONG), (None, "http://c/", LONG), (5, "http://d/", LONG), (2, "http://e/", "short"),
    (6, "http://e/", "short"), (7, "u", None), (8, "u", ""), (9, "u", "x" * 3_000_000), (10, "u", "\r\n\r\nHTTP/1.1\r\n" * 100), (None, "v", "z" * 2000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "'x' payload", "'y' digest", "1 largest")


def test_round_trip(pages):
    got = warc.round_trip(pages, with_payload=True).collect()
    want = []
    for page, url, body in ROWS:
        payload = (body or "").encode()
        first = 5 if body == LONG else None
        kind = "revisit" if first and page != first else "response"
        want.append((page, url, len(payload), hashlib.sha1(payload).hexdigest(), kind, first if kind == "revisit" else None, payload if kind == "response" else None))
    assert Counter(tuple(None if v is None else bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got) == Counter(want)


def test_selected_records_are_read_in_ranges(pages, spark):
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(pages.repartition(1), folder)
    chosen = index.where("page_id in (2, 6, 9)")
    assert {r.page_id for r in warc.read_records(chosen, folder).collect()} == {2, 6, 9}
    whole, single = warc.ranges(index).collect(), warc.ranges(index, gap=0, longest=1).collect()
    assert sum(len(r.records) for r in whole) == sum(len(r.records) for r in single) == len(ROWS)
    assert len(whole) < len(single) == len(ROWS)


def test_a_damaged_record_is_noticed():
    digest = hashlib.sha1(b"other").digest()
    with pytest.raises(ValueError, match="does not match"):
        warc.parsed(warc.record(1, "u", b"payload", digest, None))


def test_no_pages(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def marked_text(page):
    body = page[page.index("<article>") + 9 : page.find("</article>") if "</article>" in page else len(page)]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks)
    return "\n".join(t for t in texts if t)


def test_pages_with_marked_articles(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(table.selectExpr("*", "'x' text", "1 n_chars")).collect()}
    want = {r.page_id: marked_text(r.html) for r in table.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


SOUP = """<html><head><title>T</title></head><body><div id="header"><a href="/">Home</a> Site of many things that are said here</div>
<div class="menu"><ul><li><a href="#">One</a><li><a href="#">Two</a></ul></div><div class="cookie-notice">We use cookies to make this site better, do you agree?</div>
<div class="content"><h2>Title &amp; all</h2><p>The first paragraph is long enough to be text,
and says many things about many matters.<p>Short one.<p>The third has a <a href="y">link</a> &lt;in&gt; it and goes on for long enough.</div>
<div id="sideBar"><p>A sidebar text that is long, long, long, long, long, long, long, long, long, long, long.</p></div>
<div class="ad"><p>Buy this now, it is cheap and good and cheap and good and cheap and good and cheap.</p></div>
<section class="comments"><p>I liked this article a lot, and I wish there were more of its kind on this site.</p></section>
<form>Search <input name=q> now</form><footer>(c) somebody whose name is long enough to count as text, all rights reserved</footer></body></html>"""


def test_pages_without_marks():
    want = (
        "Title & all\nThe first paragraph is long enough to be text, and says many things about many matters.\nShort one.\n"
        "The third has a link <in> it and goes on for long enough."
    )
    assert html_text.extract(SOUP) == want
    article = f"<nav>menu</nav><main>{SOUP[SOUP.index('<div class=\"content\">') : SOUP.index('<div id=\"sideBar\">')]}</main>"
    assert html_text.extract(article) == want


@pytest.mark.parametrize("page", [None, "", "<p>", "<", "<!--", "<script>var x = '</p>';", "<style>p{}</style>", "&nbsp; \n", "<a b='", "<p/><br/>"])
def test_pages_without_text(page):
    assert html_text.extract(page) in ("", "<")


def test_deep_pages_take_linear_time():
    depth = 30_000
    assert html_text.extract("<div>" * depth + "text" + "</div>" * depth + "<p>" * depth) == "text"


def test_odd_markup():
    assert html_text.extract("<article><p title='a>b'>x &eacute;&#233;&amp;lt;</p><p hidden>no</p><![CDATA[raw]]></article>") == "x éé&lt;\nraw"
    assert html_text.extract("<article>a<br>b<script>1 < 2</script> c<!-- d --></article>") == "a b c"
    assert html_text.extract("<article><p>one<p class=comment>two<p>three") == "one\nthree"
    assert html_text.extract("x" * 10) == "x" * 10


STORY = "<h1>The title</h1><p>The first paragraph is long enough to be text, and says many things about many matters.</p><p>The end.</p>"
TOLD = "The title\nThe first paragraph is long enough to be text, and says many things about many matters.\nThe end."


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-comments", "hasSidebar", "sidebar", "content widget"])
def test_marks_around_the_article_do_not_remove_it(name):
    aside = "<div class='sidebar'>More to read</div>"
    for inner in (f"<article>{STORY}</article>", f"<main>{STORY}</main>", STORY):
        assert html_text.extract(f"<body><div class='{name}'>{inner}</div>{aside}</body>") == TOLD


def test_titles_as_ids_are_no_marks():
    for section in ("<section id='search-algorithms'>", "<section id='search'>", "<section id='social-effects'>", "<div id='comment-on-life'>"):
        assert html_text.extract(f"<article>{STORY}{section}<h2 id='related-work'>Related</h2><p>Yes.</p></article>") == f"{TOLD}\nRelated\nYes."
    assert html_text.extract(f"<article>{STORY}<h2 id='comments'>On comments</h2></article>") == f"{TOLD}\nOn comments"


def test_marked_articles_beside_the_article_go():
    for name in ("related", "related-posts", "site-footer", "side-bar left", "commentList", "ad-slot-2", "cookie-notice"):
        assert html_text.extract(f"<main>{STORY}</main><div class='{name}'><article>Another one</article></div>") == TOLD
        assert html_text.extract(f"<main>{STORY}<div class='{name}'><p>Another one</p></div></main>") == TOLD
    assert html_text.extract(f"<div>{STORY}</div><ol class=comments><li><article class=comment-body>I liked it</article></ol>") == TOLD


LONG_TEXT = "This paragraph is long enough to be text, and says many things about many matters, one by one, until it ends at last."
AWAY = "<div class='ad'>Buy</div><div class='notice'>Note</div><div class='promo'>Win</div>"


def test_title_byline_and_date_stay():
    page = f"<body><nav>Menu</nav><div><h1>A title</h1><p>By somebody</p><p>1 May</p><p>Short</p><p>{LONG_TEXT}</p></div></body>"
    assert html_text.extract(page) == f"A title\nBy somebody\n1 May\nShort\n{LONG_TEXT}"


@pytest.mark.parametrize("end", ["<p>So it ended.</p>", "<div><p>So it ended.</p></div>", "<ul><li>So it ended.</ul>"])
def test_short_paragraphs_beside_text_stay(end):
    for start, close in (("<div id=story>", "</div>"), ("", "")):
        page = f"<body>{start}<p>{LONG_TEXT}</p>{AWAY}{end}{close}</body>"
        assert html_text.extract(page) == f"{LONG_TEXT}\nSo it ended."
    page = f"<body><div><p>{LONG_TEXT}</p></div>{AWAY}<div class=other><p>Elsewhere.</p></div></body>"
    assert html_text.extract(page) == LONG_TEXT


def test_pages_of_short_lines_stay_whole():
    lines = [letter * n for letter, n in zip("abcde", (20, 20, 20, 25, 25), strict=True)]
    assert html_text.extract("".join(f"<p>{line}</p>" for line in lines)) == "\n".join(lines)
    assert html_text.extract(f"<div>{lines[0]}</div>{AWAY}<div>{lines[3]}</div>") == f"{lines[0]}\n{lines[3]}"


def test_links_without_an_end():
    for page in (f"<div><a href=x>Home<div><p>{LONG_TEXT}", f"<div><a href=x>Home</div><p>{LONG_TEXT}</p><a href=y>More"):
        assert html_text.extract(page) in (LONG_TEXT, f"Home\n{LONG_TEXT}")
    assert html_text.extract(f"<article><a name=top><h1>Title</h1><p>{LONG_TEXT}<p>End.</article>") == f"Title\n{LONG_TEXT}\nEnd."
    assert html_text.extract(f"<ul><li><a href=x>One<li><a href=y>Two<li><a href=z>Three</ul><p>{LONG_TEXT}</p>") == LONG_TEXT
    assert html_text.extract("<p><a href=x>All of it is a link</a></p>") == "All of it is a link"


def test_inline_adverts_and_hidden_parts_go():
    for dropped in (
        "<span class='advert'>BUY <b>NOW</b></span>", "<span hidden>x</span>", "<span style='display:none'>x</span>", "<b class=ad-slot>x <span>y</span> z</b>",
        "<i class=sponsored><div>x</div> y</i>", "<a class=share href=z>Share</a>", "<span aria-hidden=true>x",
    ):
        for start, close in (("<article>", "</article>"), ("<div>", "</div>")):
            assert html_text.extract(f"{start}<p>{LONG_TEXT}{dropped}</p><p>End.</p>{close}") == f"{LONG_TEXT}\nEnd.", dropped
    kept = "<span class=comment>kept</span> <em class='header'>too</em> <span aria-hidden=false>and this</span>"
    assert html_text.extract(f"<article><pre>{kept}</pre></article>") == "kept too and this"
    assert html_text.extract(f"<article><span class=ad>x<p>{LONG_TEXT}</article>") == LONG_TEXT


def test_windows_of_links_dive_inside_articles():
    links = "".join(f"<li><a href=x>Another story {i}</a>" for i in range(4))
    page = f"<article><h1>Title</h1><p>{LONG_TEXT}</p><ul>{links}</ul><p>So it ended.</p></article>"
    assert html_text.extract(page) == f"Title\n{LONG_TEXT}\nSo it ended."
    assert html_text.extract(f"<article><p>{LONG_TEXT}</p><p><a href=x>A link</a></p><p>End.</p></article>") == f"{LONG_TEXT}\nA link\nEnd."


@pytest.mark.parametrize("piece", ["<![CDATA[", "<svg>", "<a href=x>", "<span hidden>", "<p title=\"", "<!--", "<select>", "<b class=ad>x</i>", "&amp", "<a>x</a>", "<?x", "</a"])
def test_all_constructs_take_linear_time(piece):
    began = time.monotonic()
    html_text.extract(f"<p>{LONG_TEXT}</p>" + piece * 64_000)
    assert time.monotonic() - began < 3


def test_elements_without_an_end_do_not_swallow_the_page():
    for name in ("svg", "select", "object", "canvas", "math", "noscript", "template"):
        assert html_text.extract(f"<{name}><p>{LONG_TEXT}</p>") == LONG_TEXT
    assert html_text.extract(f"<p>{LONG_TEXT}</p><![CDATA[x>y") == f"{LONG_TEXT}\ny"


def slow_text(blocks):
    """Kept texts straight from the definition, from (text, free, parent) in one element each; nothing is marked."""
    weights = [free for _, free, _ in blocks]
    if not any(weights):
        return [text for text, _, _ in blocks]
    n, width = len(blocks), html_text.WIDTH
    sums = [sum(weights[i : i + width]) for i in range(n)]
    surge = html_text.SURGE if max(sums) >= html_text.SURGE else 1
    runs, run = [], []
    for i in range(n):
        if sums[i]:
            run.append(i)
        elif run:
            runs.append(run)
            run = []
    runs += [run] if run else []
    holders = {blocks[j][2] for i in range(n) if sums[i] >= surge for j in range(i, min(i + width, n)) if weights[j]}
    kept = []
    for run in runs:
        weighed = [j for j in range(run[0], min(run[-1] + width, n)) if weights[j]]
        if any(sums[i] >= surge for i in run):
            kept += range(weighed[0], weighed[-1] + 1)
        else:
            kept += [j for j in weighed if blocks[j][2] in holders]
    return [blocks[j][0] for j in sorted(set(kept))]


def test_unmarked_pages_against_a_slow_extractor():
    chosen = random.Random(9)
    for _ in range(300):
        blocks, page = [], ""
        for parent in range(chosen.randint(1, 4)):
            page += "<div>"
            for _ in range(chosen.randint(0, 9)):
                text = f"w{len(blocks)}" + " word" * chosen.choice([0, 1, 3, 9, 30])
                linked = chosen.random() < 0.5
                blocks.append((text, 0 if linked else len("".join(text.split())), parent))
                page += f"<p><a href=x>{text}</a></p>" if linked else f"<p>{text}</p>" if chosen.random() < 0.9 else f"<p>{text}"
            page += "</div>"
        assert html_text.extract(page).split("\n") == (slow_text(blocks) or [""]), page
