"""Line deduplication over levelled sorted runs of line hashes.

A run holds (key, n): the hash of a line and the number of documents with it,
sorted by key. A batch of documents is counted, loses by a merge anti-join the
keys that the runs have already settled (at least `min_docs` documents), and is
written as a run of its own. Whenever a level has `fanout` runs, they are merged
into one run of the next level, so a key is rewritten once per level.

Cases: a null or empty text is one empty line, which is never dropped. Lines are
compared after trimming ASCII white space and lower-casing A-Z. Rows are counted as
documents even if their doc_id repeats or is null; rows equal in doc_id and text have
equal results. Columns other than doc_id and text are carried along untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.llm.common import SPACE_CHARS, ascii_lower, scratch_path, stored, whole_row

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(lines: Column) -> Column:
    """MD5 of each line's key, null for lines without a character to compare."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(SPACE_CHARS))
        return F.when(bare != "", F.md5(ascii_lower(bare)))

    return F.transform(lines, key)


def line_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(key, n): in how many rows of `docs` each line key occurs, per `by`."""
    keys = F.array_distinct(line_keys(lines_of(F.col("text"))))
    return docs.select(*by, F.explode(keys).alias("key")).where("key is not null").groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """The runs, by level, below a shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, folder: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = folder or scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}/{uuid.uuid4().hex}"
        counts.repartition("key").sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key string, n bigint").parquet(*paths)

    @property
    def paths(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def add(self, counts: DataFrame) -> None:
        """Add the (key, n) of a batch; keys that a run has settled are left out."""
        if self.paths:
            known = self._read(self.paths).where(F.col("n") >= self.min_docs).select("key").distinct()
            counts = counts.join(known.hint("merge"), "key", "left_anti")
        self._write(counts.select("key", "n"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._read(self.levels[level]).groupBy("key").agg(F.sum("n").alias("n"))
            self._write(merged, level + 1)
            self.levels[level] = []
            level += 1

    def settled(self) -> DataFrame:
        """The keys of lines found in at least `min_docs` documents."""
        if not self.paths:
            return self.spark.createDataFrame([], "key string")
        return self._read(self.paths).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select("key")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, runs: LineRuns | None = None) -> DataFrame:
    """`docs` with its text freed of lines found in at least `min_docs` documents.

    Returns struct `doc` (the row as it was), `kept_text`, `n_lines` and
    `n_dropped`. `runs` continues a store of earlier documents, which then count, too.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, min_docs, fanout)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"), "text")
    counted = stored(line_counts(dealt, "batch"), "line-counts")
    for batch in range(batches):
        runs.add(counted.where(F.col("batch") == batch).drop("batch"))
    identity = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest")]
    found = (
        docs.select(*identity, F.posexplode(line_keys(lines_of(F.col("text")))).alias("pos", "key"))
        .where("key is not null")
        .join(stored(runs.settled(), "line-keys").hint("merge"), "key", "left_semi")
        .groupBy("id", "digest")
        .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )
    whole = docs.select(whole_row(docs).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("doc.text") == F.col("digest"))
    lines = lines_of(F.col("doc.text"))
    joined = whole.join(found, same, "left").select(
        "doc",
        lines.alias("lines"),
        F.concat(F.array(F.lit(-1)), F.coalesce(F.col("dropped"), F.expr("array()").cast("array<int>")), F.array(F.size(lines))).alias("edges"),
    )
    # what lies between two dropped lines is kept
    between = F.zip_with(
        F.expr("slice(edges, 1, size(edges) - 1)"),
        F.expr("slice(edges, 2, size(edges) - 1)"),
        lambda low, high: F.slice(F.col("lines"), low + 2, high - low - 1),
    )
    return joined.select(
        "doc",
        F.array_join(F.flatten(between), "\n").alias("kept_text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("edges") - 2).cast("bigint").alias("n_dropped"),
    )
