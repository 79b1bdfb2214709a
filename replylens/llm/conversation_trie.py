"""The trie of the prefixes that conversations share, built by cutting at half depth.

Depths are numbered from 0 (the textless root); all conversations are shorter than 2^J turns. A strand is the part
of a conversation in one segment of depths [i * 2^j, (i + 1) * 2^j), below the node at the segment's begin, its root.
The recursion takes all segments of one width at once:

* Cut: strands of width 2w are cut in the middle. The node at the cut is named by the name of the root and the digest of the
  upper half, so equal prefixes get equal names without being compared turn by turn. Of the upper halves one per
  name goes on, with the smallest conversation and the number of conversations it stands for; the lower halves hang
  below the named node. Digests of halves are those of a binary tree over each conversation's turns.
* At width 1 strands are the nodes of the trie, each with its parent.
* Graft: sums over subtrees first go up, width by width: the sum of a segment below its root is that of its upper half
  and those of the lower halves below its cut nodes. Then they are handed down to the cut nodes, widest
  segments first: what lies below a cut node is the sum of the lower half below it and what lies below the nodes at that
  half's end. For this each node keeps the names of the cuts of the segments that end at it.

Each step is one grouping of narrow rows, and halving makes the later steps shorter. A conversation with any number of turns or
copies is never one row or one task's group: turns are numbered by ranges, strands are grouped with partial sums.
Only the digest of the conversations that end at one node has to read their ids in order: they come as chunks
of CHUNK bytes and are read as a stream.

Cases: a null role or text is empty; turns without a conv_id belong to no conversation and are left out. Turns are
ordered by turn, null first, then by role, the first 64 characters of the text and its digest; rows that are equal in all of them count
as turns of their own. Very long texts are read once, for their digest and words. An empty table gives no nodes, not even a root. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import stored
from replylens.operators.numbering import number_rows

# conversations are rebuilt from the one with the next lower multiple of this number
FAMILY = 20
BORROWED = 4
ROOT = ""
CHUNK = 1 << 16


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, item, words): numbered turns from 1, with a digest of role and text and the words of the text."""
    chosen = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), _text("role").alias("role"), _text("text").alias("text"))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")
    item = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    # texts stay behind: beginnings and digests order equal turn numbers
    narrow = chosen.where("conv_id is not null").select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("begin"), item.alias("item"), words.alias("words"))
    return number_rows(narrow, ["conv_id"], ["turn", "role", "begin", "item"], "pos").select("conv_id", "pos", "item", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as rebuilt, as (conv_id, pos, item, words) and the list (conv_id) of all, turnless ones too.

    The first h turns of each are those of the first of its family (conv_id - conv_id % FAMILY), where h is crc32(conv_id as text) %
    BORROWED; its own turns after its first h follow.
    """
    turns = stored(turns_of(conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % BORROWED
    ids = turns.where("pos = 1").select("conv_id")
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < BORROWED))
    wanted = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("source"))
    # at most FAMILY conversations and three turns meet at one source
    lent = wanted.join(first.withColumnRenamed("conv_id", "source").hint("merge"), "source").where("pos <= h")
    lent = lent.select("conv_id", "pos", "item", "words")
    lengths = first.groupBy("conv_id").agg(F.max("pos").alias("n"))
    n_lent = wanted.join(lengths.withColumnRenamed("conv_id", "source").hint("merge"), "source", "left")
    shifts = n_lent.select("conv_id", (F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.where(F.col("pos") > h).join(shifts.hint("merge"), "conv_id")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "item", "words")
    return stored(lent.unionByName(own), "rebuilt-turns"), ids


def _named(root: Column, digest: Column) -> Column:
    return F.md5(F.concat(root, digest))


def _digests(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level j the digests of whole segments: (c, i, d) for the turns i * 2^j + 1 to (i + 1) * 2^j of conversation c."""
    found = [turns.select(F.col("conv_id").alias("c"), (F.col("pos") - 1).alias("i"), F.col("item").alias("d"))]
    for j in range(1, levels):
        half = F.when(F.col("i") % 2 == 0, F.col("d"))
        other = F.when(F.col("i") % 2 == 1, F.col("d"))
        pairs = found[-1].groupBy("c", F.shiftright("i", 1).alias("i")).agg(F.max(half).alias("a"), F.max(other).alias("b"))
        found.append(stored(pairs.where("a is not null and b is not null").select("c", "i", F.md5(F.concat("a", "b")).alias("d")), f"digests-{j}"))
    return found


def _cut(strands: DataFrame, digests: DataFrame, j: int) -> tuple[DataFrame, DataFrame]:
    """Strands of width 2^(j + 1) as strands of width 2^j, and the ends (conv_id, name) of conversations that end at a cut.

    A strand (i, root, c, n, rest, tail, links): conversation c stands for n; `rest` is its number of turns in the segment if c ends
    there, null if it reaches the segment's end, the node `tail`; links are the cuts of wider segments that end at tail.
    """
    half = 1 << j
    upper = digests.where("i % 2 = 0").select("c", F.shiftright("i", 1).alias("i"), "d")
    met = strands.join(upper.hint("merge"), ["c", "i"], "left")
    cut = F.when(F.col("rest").isNull() | (F.col("rest") >= half), _named(F.col("root"), F.col("d")))
    met = stored(met.withColumn("cut", cut).drop("d"), f"strands-{j}")
    reaching = met.where("cut is not null")
    # a cut has one root; as a key it leaves numbers to aggregate
    above = reaching.groupBy("cut", "i", "root").agg(F.min("c").alias("c"), F.sum("n").alias("n"))
    link = F.struct(F.lit(j).alias("level"), F.col("root").alias("at"))
    above = above.select(
        (F.col("i") * 2).alias("i"), "root", "c", "n", F.lit(None).cast("bigint").alias("rest"), F.col("cut").alias("tail"), F.array(link).alias("links")
    )
    ending = met.where("cut is null").select((F.col("i") * 2).alias("i"), "root", "c", "n", "rest", "tail", "links")
    below = reaching.where(F.col("rest").isNull() | (F.col("rest") > half)).select(
        (F.col("i") * 2 + 1).alias("i"),
        F.col("cut").alias("root"),
        "c",
        "n",
        (F.col("rest") - half).alias("rest"),
        "tail",
        F.when(F.col("tail").isNotNull(), F.concat("links", F.array(F.struct(F.lit(j).alias("level"), F.col("cut").alias("at"))))).alias("links"),
    )
    ends = reaching.where(F.col("rest") == half).select(F.col("c").alias("conv_id"), F.col("cut").alias("name"))
    return above.unionByName(ending).unionByName(below), ends


def trie(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes but the root (depth, name, parent, conv_id, n_convs, links) and where conversations end (conv_id, name)."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("rest"))
    most = lengths.agg(F.max("rest")).first()[0] or 0
    levels = int(most).bit_length()
    kinds = "array<struct<level: int, at: string>>"
    strands = ids.join(lengths.hint("merge"), "conv_id").select(
        F.lit(0).cast("bigint").alias("i"), F.lit(ROOT).alias("root"), F.col("conv_id").alias("c"), F.lit(1).cast("bigint").alias("n"),
        "rest", F.lit(None).cast("string").alias("tail"), F.lit(None).cast(kinds).alias("links"),
    )
    ends = ids.join(lengths.hint("merge"), "conv_id", "left_anti").select("conv_id", F.lit(ROOT).alias("name"))
    digests = _digests(turns, levels)
    for j in reversed(range(levels)):
        strands, ended = _cut(strands, digests[j], j)
        ends = ends.unionByName(ended)
    # conversations end at cuts, so strands of width 1 all reach their node
    found = strands.select((F.col("i") + 1).alias("depth"), F.col("tail").alias("name"), F.col("root").alias("parent"), F.col("c").alias("conv_id"), F.col("n").alias("n_convs"), "links")
    return stored(found, "trie-nodes"), ends


def _low_bit(depth: Column) -> Column:
    """The level of the cut that a depth is: the number of zeros at the end of its binary form."""
    return (F.length(F.bin(depth)) - F.length(F.rtrim(F.bin(depth), F.lit("0")))).cast("int")


def below(values: DataFrame, sums: list[str], levels: int) -> DataFrame:
    """(name, and per name in `sums` its sum over all nodes below) from values per node (name, parent, depth, links).

    Nodes without anything below them may be missing.
    """
    links = values.select("name", _low_bit(F.col("depth")).alias("level"), "links")
    own = values.select(F.col("parent").alias("name"), F.lit(None).cast("int").alias("level"), F.lit(None).cast(values.schema["links"].dataType).alias("links"), *sums)
    start = links.select("*", *[F.lit(0).cast("bigint").alias(s) for s in sums]).unionByName(own)

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("name").agg(F.max("level").alias("level"), F.max("links").alias("links"), *[F.sum(s).alias(s) for s in sums])

    # up: what a segment of width 2^j holds below its root
    held = stored(gathered(start), "grafts")
    final = []
    for j in range(levels):
        cuts = held.where(F.col("level") == j)
        final.append(cuts)
        to_root = cuts.select(F.filter("links", lambda x: x["level"] == j)[0]["at"].alias("name"), F.lit(None).cast("int").alias("level"),
                              F.lit(None).cast(values.schema["links"].dataType).alias("links"), *sums)
        held = stored(gathered(held.where((F.col("level") > j) | F.col("level").isNull()).unionByName(to_root)), f"grafts-{j}")
    # down: what lies below the nodes at the end of a segment lies below its cut, too
    done = [held.select("name", *sums)]
    handed = None
    for j in reversed(range(levels)):
        here = final[j] if handed is None else stored(gathered(final[j].unionByName(handed.where(F.col("to") == j).drop("to"))), f"below-{j}")
        done.append(here.select("name", *sums))
        if j:
            inner = here.select(F.col("level").alias("own"), F.explode("links").alias("x"), *sums).where("x.level < own")
            more = inner.select(F.col("x.at").alias("name"), F.col("x.level").alias("to"), F.lit(None).cast("int").alias("level"),
                                F.lit(None).cast(values.schema["links"].dataType).alias("links"), *sums)
            handed = more if handed is None else handed.unionByName(more)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) as chunks (name, first id, text of ids)."""
    last, held, size = None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (name != last or size > CHUNK):
                out.append((last, held[0], ",".join(map(str, held))))
                held, size = [], 0
                if len(out) == 256:
                    yield _chunk_rows(out)
                    out = []
            last = name
            held.append(conv)
            size += 12
    if held:
        out.append((last, held[0], ",".join(map(str, held))))
    if out:
        yield _chunk_rows(out)


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    names, first, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], names=["name", "first", "ids"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order as (name, sha256 of all ids of the name)."""
    last, digest = None, None
    for batch in batches:
        names, hashes = [], []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name == last:
                digest.update(b",")
            else:
                if digest is not None:
                    names.append(last)
                    hashes.append(digest.hexdigest())
                last, digest = name, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes, pa.string())], names=["name", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["name", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the ascending ids of the conversations that end at a node, joined by commas."""
    sorted_ids = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    chunks = stored(sorted_ids.mapInArrow(_chunked, "name string, first bigint, ids string"), "end-chunks")
    in_order = chunks.repartition("name").sortWithinPartitions("name", "first").select("name", "ids")
    return in_order.mapInArrow(_hashed, "name string, ends_sha256 string")


def nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of all prefixes, the root included, with the sums over its subtree.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    found, ends = trie(turns, ids)
    levels = int(found.agg(F.max("depth")).first()[0] or 0).bit_length()
    last = turns.select("conv_id", F.col("pos").alias("depth"), "words")
    found = found.join(last.hint("merge"), ["conv_id", "depth"])
    children = found.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    found = found.join(children.hint("merge"), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("words")
    found = stored(found.select("*", leaf.alias("leaves"), saved.alias("saved")), "trie-values")
    grafts = stored(below(found, ["leaves", "saved"], levels), "grafted").select("name", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))

    whole = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    n_top = found.where("depth = 1").count()
    columns = ["conv_id", "depth", "name", "parent", "n_convs", "n_children", "leaves", "saved"]
    row = (whole["conv_id"], 0, ROOT, None, whole["n_convs"], n_top, int(n_top == 0), 0)
    every = found.select(*columns)
    root = found.sparkSession.createDataFrame([row] if whole["n_convs"] else [], every.schema)
    parents = every.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # the children of the root may be most nodes, and need no join
    top = every.where("depth = 1").unionByName(root)
    top = top.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(whole["conv_id"])).cast("bigint"))
    deeper = every.where("depth > 1").join(parents.hint("merge"), "parent", "left")
    joined = top.unionByName(deeper).join(grafts.hint("merge"), "name", "left").join(end_digests(ends).hint("merge"), "name", "left")
    nothing = F.lit(0).cast("bigint")
    return joined.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", nothing)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", nothing)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
