"""Reading review files.

Table readers return all columns as text plus `_file` and `_pos`, which grows in
file order; review readers return `source`, `pos` and `review`. Files are read in
parallel; the options that keep a file in one task say so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.functions.text import is_header_like, strip_blank, strip_leading
from replylens.operators.cleaning import (
    EQUALS_RULE,
    PREFIX_RULE,
    clean_reviews,
    is_quoted,
    not_missing,
    nullify_na,
    promote_header,
    strip_quotes_if_first_quoted,
    without_quotes,
)
from replylens.session import durable, join_bounded
from replylens.sources.columns import detect_text_column, pick_column, sample_lines, sample_values
from replylens.sources.delimited import Delimited

PLACE = ("_file", "_pos")
FORMATS = ("csv", "txt", "xls", "xlsx")


def _placed(df: DataFrame) -> DataFrame:
    """Add the file and a position that follows the order of rows within it.

    Splits of a file keep their order among the read's partitions, so the id
    grows along the file. It is only comparable within one read.
    """
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_pos"))


def column_names(cells: list[str]) -> list[str]:
    """Names for the cells of a header: empty ones are numbered, repeated ones get a number of their own."""
    names = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(cells)]
    given, times, out = set(names), dict.fromkeys(names, 0), []
    for name in names:
        unique = name
        if name in out:
            while unique in given:
                times[name] += 1
                unique = f"{name}.{times[name]}"
            given.add(unique)
        out.append(unique)
    return out


def read_csv(spark: SparkSession, path: str | list[str], header: bool = True, multi_line: bool = True) -> DataFrame:
    """Delimited files with the same header, all columns STRING, missing-value texts as NULL.

    Repeated names are numbered (`a`, `a.1`), empty ones too. Files are refused whose header differs from another's,
    which are no UTF-8 or whose quotes do not close; a row with more cells than the header and
    the row after it stops the read. If that row is wider than the header, the cells before the named ones
    have no column. Without a header the columns are `0`, `1`, ... as many as the widest first row has.
    Large files are split; with `multi_line` quoted cells may contain line breaks.
    """
    table = Delimited(spark, path, multi_line)
    files = table.files()
    refused = files.where("broken or unclosed").select("source", "broken").first()
    if refused:
        raise ValueError(f"{refused.source} " + ("is not UTF-8" if refused.broken else "has quotes that do not close"))
    if header:
        found = files.where("names is not null").groupBy("names").agg(F.max("second_width").alias("width")).limit(2).collect()
        if len(found) > 1:
            raise ValueError("the files have different headers")
        names = column_names(found[0].names) if found else []
        width = max(len(names), found[0].width or 0) if found else 0
        rows = join_bounded(table.rows(), files.select("source", "first"), ["source"]).where(F.col("pos") > F.col("first"))
    else:
        width = files.agg(F.max(F.size("names"))).first()[0] or 0
        names = [str(i) for i in range(width)]
        rows = table.rows()
    too_wide = F.raise_error(F.concat(F.lit("a row is wider than its table: "), "source", F.lit(" "), F.col("pos").cast("string")))
    cells = F.when(F.size("cells") > width, too_wide.cast("array<string>")).otherwise(F.col("cells"))
    lead = width - len(names)
    columns = [not_missing(F.get(cells, F.lit(lead + i))).alias(name) for i, name in enumerate(names)]
    return rows.select(*columns, F.col("source").alias("_file"), F.col("pos").alias("_pos"))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in PLACE]


def _as_reviews(df: DataFrame, column: str) -> DataFrame:
    place = (F.col("_file").alias("source"), F.col("_pos").alias("pos"))
    return df.select(*place, F.col(f"`{column}`").alias("review"))


def reviews_from_column(df: DataFrame, column: str, header_rule: str | None = PREFIX_RULE) -> DataFrame:
    """Clean reviews of one column, chosen by name or by number; empty if there is none."""
    chosen = pick_column(data_columns(df), column)
    if chosen is None:
        return _as_reviews(df, data_columns(df)[0]).limit(0)
    return clean_reviews(_as_reviews(df, chosen), header_rule)


def read_csv_reviews(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Reviews of a file with a header: detected column, quotes stripped if the first has them."""
    df = read_csv(spark, path, True, multi_line)
    column = detect_text_column(data_columns(df))
    return strip_quotes_if_first_quoted(clean_reviews(_as_reviews(df, column)))


def read_csv_headerless(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Reviews of a file without a header: its only or last column."""
    df = read_csv(spark, path, False, multi_line)
    return clean_reviews(_as_reviews(df, data_columns(df)[-1]))


def read_sheet_reviews(df: DataFrame, header: bool = True) -> DataFrame:
    """Reviews of a spreadsheet already loaded as text columns with `_file` and `_pos`.

    Without a header its only or last column is taken.
    """
    names = data_columns(df)
    if not header:
        return clean_reviews(nullify_na(_as_reviews(df, names[-1]), ["review"]), EQUALS_RULE)
    column = detect_text_column(names)
    reviews = _as_reviews(df, column)
    if len(names) == 1 and not _is_hinted(column):
        reviews = promote_header(reviews)
    return clean_reviews(nullify_na(reviews, ["review"]), EQUALS_RULE)


def _is_hinted(column: str) -> bool:
    # a name that no hint fits is only chosen as the last column
    return detect_text_column([column, ""]) == column


def _text(df: DataFrame) -> DataFrame:
    """Text of any files; bytes that are not UTF-8 are left out."""
    mended = F.regexp_replace(F.make_valid_utf8("value"), "\ufffd", "")
    return df.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(mended))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-empty lines that are no `review ...` labels."""
    return clean_reviews(_as_reviews(_text(_placed(spark.read.text(path))), "value"))


def read_cells(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """(source, pos, cells): every row with all its cells, however many, also empty ones at its end.

    Bytes that are not UTF-8 are left out. Large files are split; with `multi_line` quoted cells may contain line breaks.
    """
    return Delimited(spark, path, multi_line).rows()


def _usable(cell: Column) -> Column:
    return (strip_leading(cell) != "") & ~is_header_like(strip_leading(cell), PREFIX_RULE)


def _first_usable(cells: str = "cells") -> Column:
    return strip_blank(F.get(F.filter(cells, _usable), F.lit(0)))


def read_ragged_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Rows of different lengths: the last cell of each, if the file's first line has several.

    Files that yield nothing that way fall back to the first usable cell of each row.
    """
    table = Delimited(spark, path, multi_line)
    rows = join_bounded(table.rows(), table.files().select("source", "top_width"), ["source"])
    last = F.element_at("cells", -1)
    found = rows.where("top_width > 1").groupBy("source").agg(F.count_if(_usable(last)).alias("n")).where("n > 0")
    marked = join_bounded(rows, found.select("source", F.lit(True).alias("by_last")), ["source"], "left")
    review = F.when(F.col("by_last"), F.when(_usable(last), last)).otherwise(_first_usable())
    return marked.select("source", "pos", review.alias("review")).filter(F.col("review").isNotNull())


def read_text_reviews(spark: SparkSession, path: str | list[str], whole_files: bool = True) -> DataFrame:
    """Plain text: blocks between blank lines, or lines in files without a blank line.

    With `whole_files` a file is one row and decides for itself, which suits
    many files of ordinary size. Without it files are split, for sizes that no
    task should hold; line ends must then be plain newlines.
    """
    if whole_files:
        return _whole_text_reviews(spark, path)
    lines = _as_reviews(_text(_placed(spark.read.text(path))), "value")
    blocks = _as_reviews(_text(_placed(spark.read.text(path, lineSep="\n\n"))), "value")
    empty = F.col("review") == ""
    # An empty line counts unless it is the very first one of its file.
    divided = (
        lines.groupBy("source")
        .agg(
            F.count_if(empty).alias("n"),
            F.min("pos").alias("first"),
            F.min(F.when(empty, F.col("pos"))).alias("first_empty"),
        )
        .filter(F.col("n") - (F.col("first") == F.col("first_empty")).cast("int") > 0)
        .select("source", F.lit(True).alias("divided"))
    )
    by_line = join_bounded(lines, divided, ["source"], "left_anti")
    by_block = join_bounded(blocks, divided, ["source"], "left_semi")
    return clean_reviews(by_line.unionByName(by_block), header_rule=None)


def _whole_text_reviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = _text(_placed(spark.read.text(path, wholetext=True)))
    body = F.regexp_replace("value", "\r\n?", "\n")
    parts = F.when(body.contains("\n\n"), F.split(body, "\n\n")).otherwise(F.split(body, "\n"))
    reviews = files.select(F.col("_file").alias("source"), F.posexplode(parts).alias("p", "review"))
    return clean_reviews(reviews.select("source", F.col("p").cast("bigint").alias("pos"), "review"), header_rule=None)


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        headers = [column_names(cells) for cells in batch.column(1).to_pylist()]
        places = [names.index(detect_text_column(names)) for names in headers]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int32())], names=["source", "place"])


HEADED, HEADLESS, BY_LINE, BY_LAST, BY_CELL = range(5)


def csv_with_fallbacks(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Per file, the first way of reading delimited text that finds any review.

    In order: by its own header, without a header, line by line, cell by cell. The first two refuse files that are not
    UTF-8, have quotes that do not close, or a row wider than the header and the row after it (without a header: than the
    first row); the others leave out such bytes. Files are walked for their quotes, parsed once to see which way
    each takes, and parsed again for what it says.
    """
    table = Delimited(spark, path, multi_line)
    files = table.files()
    detected = files.where("names is not null").select("source", "names").mapInArrow(_detected, "source STRING, place INT")
    width = F.size("names")
    heads = files.join(detected, "source", "left").select(
        "source",
        "first",
        width.alias("width"),
        F.greatest(width, F.coalesce("second_width", width)).alias("widest"),
        "top_width",
        (F.col("broken") | F.col("unclosed")).alias("refused"),
        # cells before the named ones have no name
        (F.col("place") + F.greatest(F.coalesce("second_width", width) - width, F.lit(0))).alias("place"),
    )
    rows = join_bounded(table.rows(), heads, ["source"])

    def usable(cell: Column) -> Column:
        present = not_missing(cell)
        return F.when(_usable(present), present)

    named = F.when(F.col("pos") > F.col("first"), usable(F.get("cells", F.col("place"))))
    final, last = usable(F.get("cells", F.col("width") - 1)), F.element_at("cells", -1)
    found = rows.select("*", named.alias("named"), final.isNotNull().alias("has_final"), _usable(last).alias("has_last"))
    seen = found.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("first", "width", "widest", "top_width", "refused", "place")],
        F.max(F.size("cells")).alias("most"),
        F.count("named").alias("n_named"),
        F.count_if("has_final").alias("n_final"),
        F.count_if("has_last").alias("n_last"),
        F.min(F.when(F.col("named").isNotNull(), F.col("pos"))).alias("p_named"),
        F.min(F.when(strip_leading(F.col("named")).startswith('"') & is_quoted(strip_blank(F.col("named"))), F.col("pos"))).alias("p_quoted"),
    )
    whole = ~F.col("refused")
    way = (
        F.when(whole & (F.col("most") <= F.col("widest")) & (F.col("n_named") > 0), F.lit(HEADED))
        .when(whole & (F.col("most") <= F.col("width")) & (F.col("n_final") > 0), F.lit(HEADLESS))
        .when((F.col("top_width") > 1) & (F.col("n_last") > 0), F.lit(BY_LAST))
        .otherwise(F.lit(BY_CELL))
    )
    ways = durable(seen.select("source", "first", "width", "place", way.alias("way"), F.coalesce(F.col("p_named") == F.col("p_quoted"), F.lit(False)).alias("quoted")))
    undecided = ways.where(F.col("way") > BY_LINE).select("source")
    by_line = None
    if not undecided.isEmpty():
        by_line = join_bounded(read_lines(spark, path), undecided, ["source"], "left_semi").select("source", "pos", "review")
        ways = durable(ways.join(by_line.select("source").distinct(), "source", "left_anti"))
    kept = join_bounded(table.rows(), ways, ["source"])
    review = (
        F.when(F.col("way") == HEADED, F.when(F.col("quoted"), without_quotes(strip_blank(named))).otherwise(strip_blank(named)))
        .when(F.col("way") == HEADLESS, strip_blank(final))
        .when(F.col("way") == BY_LAST, F.when(_usable(last), last))
        .otherwise(_first_usable())
    )
    by_row = kept.select("source", "pos", review.alias("review")).where("review is not null")
    return by_row if by_line is None else by_row.unionByName(by_line)


def extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path else ""


def is_allowed(path: str) -> bool:
    return extension(path) in FORMATS


def read_reviews(spark: SparkSession, path: str, column: str | None = None, whole_files: bool = True) -> DataFrame:
    """Reviews of a file, by extension; a chosen column or a detected one.

    Delimited files are split if they are large; with `whole_files=False` so are plain texts, and cells must not hold line breaks then.
    """
    kind = extension(path)
    if kind == "txt":
        return read_text_reviews(spark, path, whole_files)
    if kind == "csv" and column is None:
        return csv_with_fallbacks(spark, path, whole_files)
    if kind == "csv":
        return reviews_from_column(read_csv(spark, path, multi_line=whole_files), column)
    if kind in ("xls", "xlsx"):
        raise ValueError("spreadsheets are loaded elsewhere; pass their table to read_sheet_reviews")
    raise ValueError(f"unsupported file extension: {kind}")


@dataclass(frozen=True)
class Inspection:
    """What a file looks like: its columns and the first values of each."""

    columns: list[str]
    sample: dict[str, list[str]]
    file_type: str
    no_header: bool = False
    error: str | None = None


def inspect_file(spark: SparkSession, path: str) -> Inspection:
    """Look at the first rows of a file; a file that cannot be read is reported, not raised."""
    kind = extension(path)
    if kind == "txt":
        try:
            lines = _as_reviews(_placed(spark.read.text(path)), "value")
            return Inspection(["text"], {"text": [r.value for r in sample_lines(lines).collect()]}, kind)
        except Exception as failure:
            return Inspection([], {}, kind, error=str(failure))
    if kind != "csv":
        return Inspection([], {}, "unknown", error=f"Unsupported file extension: {kind}")
    failure = None
    for header in (True, False):
        try:
            table = read_csv(spark, path, header)
            names = data_columns(table)
            sample: dict[str, list[str]] = {name: [] for name in names}
            # at most three values per column come back
            for row in sample_values(table).orderBy("column_ord", "sample_ord").collect():
                sample[row.column_name].append(row.value)
            return Inspection(names, sample, kind, no_header=not header)
        except Exception as error:
            failure = error
    return Inspection([], {}, kind, error=str(failure))


def read_staged(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A staged review set; only the partition of its run is listed and read."""
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def read_report(spark: SparkSession, path: str, report_name: str) -> DataFrame:
    """The last complete version of a stored report, as it was written; only its partition is read. An unknown name is an error."""
    root = path.rstrip("/")
    try:
        manifest = spark.read.schema("report_name STRING, version STRING").parquet(f"{root}/manifest/*")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no reports at {path}") from missing
    version = manifest.filter(F.col("report_name") == F.lit(report_name)).agg(F.max("version")).first()[0]
    if version is None:
        raise FileNotFoundError(f"no report named {report_name}")
    return spark.read.parquet(f"{root}/versions/{version}").filter(F.col("report_name") == F.lit(report_name))
