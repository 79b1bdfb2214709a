"""Looking at a table before reading reviews from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.fixed_values import TEXT_COLUMN_HINTS
from replylens.functions.text import strip_blank

SAMPLE_ROWS = 3


def detect_text_column(columns: Sequence[str]) -> str:
    """The column that most likely holds the reviews, from the names alone."""
    if not columns:
        raise ValueError("the table has no columns")
    favourite = TEXT_COLUMN_HINTS[0]
    exact = [c for c in columns if c.lower() == favourite]
    partial = [c for c in columns if any(hint in c.lower() for hint in TEXT_COLUMN_HINTS)]
    return (exact + partial + [columns[-1]])[0]


def pick_column(columns: Sequence[str], wanted: str) -> str | None:
    """A column by name, or by zero-based number where no name fits."""
    if wanted in columns:
        return wanted
    if wanted.isdecimal() and int(wanted) < len(columns):
        return columns[int(wanted)]
    return None


def only_column(columns: Sequence[str]) -> str | None:
    """The column to take without asking, when there is just one."""
    return columns[0] if len(columns) == 1 else None


def sample_values(df: DataFrame, pos: str = "_pos", n: int = SAMPLE_ROWS) -> DataFrame:
    """The first values of every column as text: (column_ord, column_name, sample_ord, value)."""
    names = [c for c in df.columns if c not in ("_file", pos)]
    head = df.orderBy(pos).limit(n)  # n rows get further, whatever the table holds
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in names])
    rows = head.agg(F.array_sort(F.collect_list(F.struct(F.col(pos), cells.alias("cells")))).alias("rows"))
    per_row = rows.select(F.posexplode("rows").alias("sample_ord", "row"))
    per_cell = per_row.select("sample_ord", F.posexplode("row.cells").alias("column_ord", "value"))
    named = F.get(F.array(*[F.lit(c) for c in names]), F.col("column_ord"))
    return per_cell.select("column_ord", named.alias("column_name"), "sample_ord", "value")


def sample_lines(lines: DataFrame, pos: str = "pos", n: int = SAMPLE_ROWS) -> DataFrame:
    """The first non-empty lines of a text."""
    return lines.select(pos, strip_blank(F.col("review")).alias("value")).filter("value <> ''").orderBy(pos).limit(n)
