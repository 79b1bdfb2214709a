"""Row numbers and row limits in file order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replylens.session import durable, join_bounded

# A group of at most so many rows is sorted in one task,
GROUP_ROWS = 1_000_000
# or of so many with texts.
WIDE_ROWS = 20_000
_WIDE = ("string", "binary", "array", "map", "struct", "variant")
# Rows of a group are pruned in so many parts before they are numbered.
PRUNING_PARTS = 64


def _offsets(placed: DataFrame, group: list[str], weight: Column, total: str | None) -> DataFrame:
    """Per range of a group what to add to a row's place: the rows of the ranges before it, less the place of its first."""
    sizes = placed.groupBy(*group, "_range").agg(F.sum(weight).alias("_size"), F.min("_at").alias("_begin"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group,
        "_range",
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_begin") + 1).alias("_shift"),
        *([F.sum("_size").over(whole).alias(total)] if total else []),
    )


def _ranged(df: DataFrame, group: list[str], order: list[str], name: str, total: str | None) -> DataFrame:
    """Rows sorted once by ranges of (group, position), whatever the positions look like, and kept; a row's
    number is its place in its range plus the sizes of the group's ranges before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the partition in its upper bits and the row's place there in the lower 33
    placed = durable(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    numbered = join_bounded(placed, _offsets(placed, group, F.lit(1), total), [*group, "_range"])
    return numbered.withColumn(name, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    pos: str | Sequence[str] = "pos",
    name: str = "review_number",
    total: str | None = None,
    most: int | None = None,
) -> DataFrame:
    """Number rows 1..n per group in order of `pos` (one or more columns), optionally with n itself.

    Groups are counted first, unless it is known how many rows they have at `most`. Up to GROUP_ROWS rows a group is sorted in one task by `row_number()`, or up to
    WIDE_ROWS if rows have texts or lists besides their place. Beyond that a task
    would have to sort too much: then the places alone, without the other columns, are sorted by ranges and numbered,
    and the rows get their numbers by a join on group and place. Only if places repeat
    in a group whole rows are sorted by ranges and kept.
    """
    group = list(keys)
    place = [pos] if isinstance(pos, str) else list(pos)
    wide = any(f.dataType.typeName() in _WIDE for f in df.schema.fields if f.name not in (*group, *place))
    allowed = min(GROUP_ROWS, WIDE_ROWS) if wide else GROUP_ROWS
    if most is None:
        most = df.count()
        if most > allowed and group:
            most = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if most <= allowed:
        whole = Window.partitionBy(*group)
        numbered = df.withColumn(name, F.row_number().over(whole.orderBy(*place)).cast("bigint"))
        return numbered.withColumn(total, F.count(F.lit(1)).over(whole)) if total else numbered
    order = [*group, *place]
    narrow = df.select(*order)
    numbered = _ranged(narrow, group, order, name, total)
    if not narrow.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return _ranged(df, group, order, name, total)
    renamed = numbered.select(*[F.col(c).alias(f"_{i}_of_place") for i, c in enumerate(order)], name, *([total] if total else []))
    same = F.lit(True)
    for i, c in enumerate(order):
        mine, theirs = df[c], renamed[f"_{i}_of_place"]
        same = same & (mine.eqNullSafe(theirs))
    return df.join(renamed.hint("merge"), same).drop(*[f"_{i}_of_place" for i in range(len(order))])


def run_positions(reviews: DataFrame, order: Sequence[str] = ("source", "pos")) -> DataFrame:
    """Reviews of several files as one run: `pos` becomes unique, in the order given; it was `source_pos` before."""
    numbered = number_rows(reviews.withColumn("source_pos", F.col("pos")), (), order, name="_n")
    return numbered.withColumn("pos", F.col("_n") - 1).drop("_n")


def pruned(df: DataFrame, keys: Sequence[str], n: int, pos: str = "pos") -> DataFrame:
    """Rows among which the first n of each group are: at most n per group, part and task are shuffled."""
    part = F.pmod(F.xxhash64(pos), F.lit(PRUNING_PARTS)).cast("int")
    order = Window.partitionBy(*keys, "_part").orderBy(pos)
    ranked = df.withColumn("_part", part).withColumn("_nth", F.row_number().over(order))
    return ranked.filter(F.col("_nth") <= n).drop("_part", "_nth")


def first_rows(
    df: DataFrame, keys: Sequence[str], n: int, pos: str = "pos", number: str | None = None
) -> DataFrame:
    """The first n rows per group in order of `pos`, numbered if `number` names a column.

    Tasks prune their rows before the shuffle, then what is left is numbered;
    no task sorts a group, and the plan is the same for every n.
    """
    if not keys and number is None:
        return df.orderBy(pos).limit(n)
    nth = number or "_nth"
    kept = number_rows(pruned(df, keys, n, pos), keys, pos, nth, most=n * PRUNING_PARTS).filter(F.col(nth) <= n)
    return kept if number else kept.drop(nth)
