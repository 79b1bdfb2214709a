"""Rule ledger: every quality rule is evaluated once per document into a bit mask.

`ledger` stores the measurements and, in `failed`, one bit per rule. A policy is a
named, versioned set of rules; applying it is one bitwise AND, and what each rule
of a policy removes alone or together comes from one aggregate over the masks.

Cases: a null text has no words and no lines. Repeated rows are judged alike, each for itself.
Windows of words are compared by 64-bit hash inside one document. Columns of the input other
than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import SPACE_CHARS, SPACE_CLASS

# name -> condition under which a document fails; the bit is the position in this list
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_text_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count; `mask` has their bits."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(RULES))
POLICIES = (BASE, DEFAULT)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def measure(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, counts): what the rules look at, all built-in expressions; `carry` names columns to keep."""
    carry = carry or []
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    counted = docs.select("doc_id", *carry, text.alias("body"), words_of(text).alias("words"), with_words.alias("lines")).select(
        "doc_id",
        *carry,
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.size("lines").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.zip_with(
                F.zip_with("words", F.expr("slice(words, 2, size(words) - 1)"), lambda a, b: F.xxhash64(a, b)),
                F.expr("slice(words, 3, size(words) - 2)"),
                lambda pair, c: F.when(c.isNotNull(), F.xxhash64(pair, c)),
            ),
        ).alias("hashed"),
    )
    windows = counted.withColumn("windows", F.expr("slice(hashed, 1, n_words - 2)")).drop("hashed")
    # places of windows that occur again: neighbours with equal hashes once sorted by hash
    ordered = windows.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    again = F.zip_with(
        "ordered",
        F.expr("slice(ordered, 2, size(ordered) - 1)"),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    places = ordered.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.filter(again, lambda p: p.isNotNull()))))).drop("ordered")
    # a place covers three words, fewer if the next place begins before
    covered = F.aggregate(
        F.zip_with("places", F.expr("slice(places, 2, size(places) - 1)"), lambda a, b: F.when(b.isNull(), F.lit(3)).otherwise(F.least(F.lit(3), b - a))),
        F.lit(0),
        lambda total, step: total + step,
    )
    long = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines")]
    repeated = F.coalesce(F.when(F.size("places") > 0, covered), F.lit(0)).cast("bigint").alias("n_repeat_words")
    # a generator of one row: filters on the measurements stay above it, else they would repeat all the work below
    return places.select("doc_id", *carry, F.inline(F.array(F.struct(*long, repeated))))


def judge(measured: DataFrame) -> DataFrame:
    """The ledger: the measurements and `failed`, a bit for each rule that the document breaks."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def ledger(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    return judge(measure(docs, carry))


def passes(policy: Policy) -> Column:
    """Whether a row of a ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: rows failing the rule, rows only it removes, rows kept without it.

    The rows are first counted per mask, of which there are at most 2 to the
    number of rules; everything else is bitwise arithmetic on those counts.
    """
    masks = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(
        *[
            F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).alias("mask"), F.lit(BIT[r]).alias("bit"))
            for p in policies
            for r in p.rules
        ]
    )
    cut = F.col("failed").bitwiseAND(F.col("mask"))
    others = cut.bitwiseAND(F.bitwise_not("bit"))
    return (
        masks.select("failed", "n", F.inline(cases))
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum(F.when(cut.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(cut == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
            F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("kept_without"),
            F.sum(F.when(cut == 0, F.col("n")).otherwise(0)).alias("kept"),
        )
    )
