"""Code books: the values of a column and their numbers in sorted order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.timeline import MAX_ROWS, cut, number_rows
from logloom.session import settle


def code_book(
    values: DataFrame, column: str, max_rows: int = MAX_ROWS, by: Sequence[str] = ()
) -> DataFrame:
    """Distinct non-null values and their codes 0, 1, ... in sorted order, per `by` if given."""
    words = values.select(*by, column).where(F.col(column).isNotNull()).distinct()
    words = settle(words.withColumn("_book", F.lit(column)))
    # A vocabulary too long for one task is numbered slice by slice.
    book = [*by, "_book"]
    words = cut(words, max_rows, by=book, order=[column])
    numbered = number_rows(words, by=book, order=[column], name="code")
    return numbered.select(*by, column, "code")


def with_codes(df: DataFrame, column: str, book: DataFrame) -> DataFrame:
    """Replace a column's values by their codes; values outside the book become null."""
    keys = [c for c in book.columns if c != "code"]
    coded = df.join(book, keys, "left")
    return coded.withColumn(column, F.col("code")).drop("code").select(*df.columns)
