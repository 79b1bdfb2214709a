"""Looking at a review set before a run: limits, search, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.operators.numbering import first_rows, number_rows
from replylens.session import join_bounded

RUN_LIMIT = 100
PAGE_SIZE = 10


def limit_reviews(reviews: DataFrame, n: int = RUN_LIMIT, keys: Sequence[str] = ("source",)) -> DataFrame:
    """The reviews a run takes: the first n of each source.

    Which ones is decided over positions alone, so the texts are neither sorted
    nor, while few are taken, shuffled.
    """
    if not keys:
        return first_rows(reviews, (), n)
    chosen = first_rows(reviews.select(*keys, "pos"), keys, n)
    return join_bounded(reviews, chosen, [*keys, "pos"], "left_semi")


def search_reviews(reviews: DataFrame, term: str) -> DataFrame:
    """Reviews containing the term, whatever its case."""
    return reviews.filter(F.lower("review").contains(term.lower()))


def paginate(reviews: DataFrame, keys: Sequence[str] = ("source",), page_size: int = PAGE_SIZE) -> DataFrame:
    """Number reviews and say which page shows them, with the page's range and the total."""
    numbered = number_rows(reviews, keys, name="review_number", total="total_reviews")
    page = F.floor((F.col("review_number") - 1) / F.lit(page_size)).cast("bigint") + 1
    return numbered.withColumn("page", page).withColumns(
        {
            "page_first": (F.col("page") - 1) * page_size + 1,
            "page_last": F.least(F.col("page") * page_size, F.col("total_reviews")),
        }
    )


def page(paged: DataFrame, number: int) -> DataFrame:
    return paged.filter(F.col("page") == number)
