"""Rules and listed URLs against a plain loop; the Bloom filter alone against its list."""

import random
import re

import pytest
from pyspark.sql import functions as F

from replylens.llm import url_filter
from replylens.llm.queries import URL_RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def ruled(url, rules):
    host, path = split(url)
    fitting = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[1:] if fitting else (None, None)


def frames(spark, rows, rules, listed):
    return (
        spark.createDataFrame(rows, "page_id BIGINT, url STRING").selectExpr("*", "1 host", "2 path", "3 key", "4 salt", "5 verdict"),
        spark.createDataFrame(rules, "host STRING, path STRING, verdict STRING"),
        spark.createDataFrame([(u,) for u in listed], "canonical STRING"),
    )


@pytest.mark.parametrize("blocks", [1, 1 << 18])
def test_verdicts(spark, blocks):
    chosen = random.Random(3)
    hosts = ["net", "Example.NET", "a.example.net", "notexample.net", "example.com", "x.y.example.com", "org", "b.org.", "c.org:80", "org.com", ""]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/1", "/fr/", "/fr/2/?q=/en/", "//en/", "/en/#top"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x://y") for h in hosts for p in paths] + [None, "", "no scheme", "://", "a\nb://net/", "http://net/" + "a/" * 20_000]
    rules = URL_RULES + [("y", "", "block"), ("a.example.net", "/en/", "block"), ("a.example.net", "/en/", "allow"), ("org", "/f", "allow")]
    rows = [(chosen.choice([None, i, 3]), u) for i, u in enumerate(urls)] + [(9, "http://org/fr/")] * 300
    # a filter of one block lets most keys pass, which changes no result
    got = url_filter.judge(*frames(spark, rows, rules, ["org.com/en/"]), max_blocks=blocks).collect()
    assert len(got) == len(rows)
    expected = []
    for page, url in rows:
        rule, verdict = ruled(url, rules)
        expected.append((page, *split(url), rule, verdict or "allow"))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_listed_urls_are_blocked_in_any_form(spark):
    same = ["http://www.Site.test/a", "https://site.test:443/a/", "https://u:p@site.test//a/?utm_source=x&ref=y#z", "http://site.test./a/index.html"]
    other = ["http://site.test/b", "http://site.test/a?id=1", "http://sub.site.test/a", "http://site.test:8080/a"]
    rows = [(i, u) for i, u in enumerate(same + other)]
    got = url_filter.judge(*frames(spark, rows, [], ["site.test/a"])).collect()
    assert {r.page_id: r.verdict for r in got} == {i: "block" if i < len(same) else "allow" for i in range(len(rows))}
    allowed = url_filter.judge(*frames(spark, rows[:1], [("site.test", "/a", "allow")], ["site.test/a"])).first()
    assert (allowed.rule, allowed.verdict) == ("site.test/a", "allow")
    forms = spark.createDataFrame([("http://s.test/?b=2&a=1&&sid=9",), ("s.test",), (None,)], "url STRING").select(url_filter.canonical(F.col("url"))).collect()
    assert [r[0] for r in forms] == ["s.test?a=1&b=2", None, None]


def test_nothing_to_judge_or_to_judge_by(spark):
    assert url_filter.judge(*frames(spark, [], URL_RULES, ["a/b"])).count() == 0
    assert [r.verdict for r in url_filter.judge(*frames(spark, [(1, "http://a/b"), (2, None)], [], [])).collect()] == ["allow", "allow"]


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000, 60_000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.BlockedBloom(listed)
    assert bloom.table.count() <= bloom.blocks <= 2 * 20_000 * url_filter.BITS_PER_KEY / 512
    assert bloom.passing(listed).count() == 20_000
    assert bloom.passing(others).count() < 400
