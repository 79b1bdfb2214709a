"""URL filter: rules for hosts and paths, and a list of canonical URLs, behind one blocked Bloom filter.

Rules (host, path, verdict) and listed canonical URLs become keys of one list. Its Bloom filter has blocks of eight
64-bit words; a key sets one bit in each word of one block. Blocks are built by a grouped bitwise OR and
number at most MAX_BLOCKS, so the filter is broadcast whatever the length of the list; a list too long for it
only lets more keys pass. What passes meets the list itself in a hash join on the key, so a false positive
changes nothing.

A rule fits its host and all subdomains if the path of the URL starts with the rule's. The keys a URL may have
are: the last labels of its host, up to the most labels of a rule; for those that the filter lets pass, the
label with each beginning of the path that is as long as the path of some rule; and its canonical form. The longest
rule (host and path together) decides; of equal rules with different verdicts "block" does. Without a rule a listed
URL is blocked and any other allowed.

URLs are judged once each, however many rows have them. Hot keys: of a URL that a third of the rows
share one row goes through the filter; of a rule that fits a third of the URLs the hits are dealt over SALTS parts.

Cases: a null URL, or one without "://", has an empty host and path and no canonical form; only a rule
with an empty host and path fits it. Very long URLs have no more keys than the rules have labels and path
lengths. Repeated rows have equal results; an empty list or no rules at all judge nothing; columns other than
page_id and url are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import ascii_lower
from replylens.session import durable

BITS_PER_KEY = 16
WORDS = 8
# 16 MB of words
MAX_BLOCKS = 1 << 18
SALTS = 32

WHOLE = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
# query parameters that only tell where a reader came from
TRACKING = r"^(utm_[^=]*|ref|referrer|fbclid|gclid|msclkid|sessionid|sid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, WHOLE, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, WHOLE, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for URLs that differ in scheme, user, default port, "www.", doubled or closing slashes, index pages,
    tracking parameters, order of parameters or fragment; null without "://"."""
    host = F.regexp_replace(host_of(url), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"\.$", "")
    path = F.regexp_replace(path_of(url), "/{2,}", "/")
    path = F.regexp_replace(path, r"/(index\.(html?|php))?$", "")
    given = F.split(F.regexp_extract(url, WHOLE, 3), "&", -1)
    query = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.instr(url, "://") > 0, whole)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The bit of a key in a word of its block."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


class BlockedBloom:
    """A Bloom filter over a column of keys, as a table of blocks that is stored once."""

    def __init__(self, keys: DataFrame, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS):
        needed = keys.count() * bits_per_key / (64 * WORDS)
        self.blocks = 1
        while self.blocks < min(needed, max_blocks):
            self.blocks *= 2
        words = [F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]
        self.table = durable(keys.groupBy(_block(F.col("key"), self.blocks).alias("block")).agg(*words))

    def passing(self, df: DataFrame) -> DataFrame:
        """Rows whose `key` may be in the list: all that are, and few others."""
        hits = F.lit(True)
        for i in range(WORDS):
            hits = hits & (F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0)
        # at most `max_blocks` rows of fixed width
        met = df.withColumn("block", _block(F.col("key"), self.blocks)).join(F.broadcast(self.table), "block")
        return met.where(hits).select(*df.columns)


def _listing(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, rank, verdict): keys of rules, of their hosts (no verdict) and of listed URLs."""
    named = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rule = F.concat("host", "path")
    by_rule = named.select(
        F.concat(F.lit("r"), rule).alias("key"), F.struct(F.lit(1).alias("kind"), F.length(rule).alias("length"), rule.alias("rule")).alias("rank"), "verdict"
    )
    none = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("rule")).alias("rank")
    by_host = named.select(F.concat(F.lit("h"), "host").alias("key"), none, F.lit(None).cast("string").alias("verdict"))
    by_url = listed.select(F.concat(F.lit("u"), "canonical").alias("key"), none, F.lit("block").alias("verdict"))
    return by_rule.unionByName(by_host).unionByName(by_url).where("key is not null").distinct()


def _salted(df: DataFrame, of: Column) -> DataFrame:
    """Keys of rules in SALTS parts, others in one."""
    return df.withColumn("salt", F.when(F.col("key").startswith("r"), of).otherwise(F.array(F.lit(0)))).withColumn("salt", F.explode("salt"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of `pages`.

    `rules` has the columns host, path and verdict ("allow" or "block"), `listed` the column canonical (see `canonical`).
    """
    shapes = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length(F.coalesce("path", F.lit("")))).alias("lengths")).first()
    labels, lengths = shapes["labels"] or 0, F.array(*[F.lit(n) for n in sorted(shapes["lengths"])]).cast("array<int>")
    listing = durable(_listing(rules, listed))
    bloom = BlockedBloom(listing.select("key").distinct(), max_blocks=max_blocks)

    chosen = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    urls = chosen.select("url").distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    last = f"transform(sequence(1, least({max(labels, 1)}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))"
    suffixes = parts.select("url", "path", F.explode(F.expr(last)).alias("suffix")).withColumn("key", F.concat(F.lit("h"), "suffix"))
    begins = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.concat(F.lit("r"), "suffix", F.substring(F.col("path"), F.lit(1), n)))
    by_rule = bloom.passing(suffixes).select("url", F.explode(begins).alias("key"))
    by_url = urls.select("url", F.concat(F.lit("u"), canonical(F.col("url"))).alias("key")).where("key is not null")
    possible = bloom.passing(by_rule).unionByName(bloom.passing(by_url))

    exact = _salted(listing.where("verdict is not null"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.array(F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    hits = _salted(possible, salt).join(exact.hint("shuffle_hash"), ["key", "salt"])
    verdicts = hits.groupBy("url").agg(F.max(F.struct("rank", "verdict")).alias("best"))
    met = chosen.join(verdicts, "url", "left")
    return met.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rank.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )

