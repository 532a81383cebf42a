"""The review of an inbox: one narrow pass over the files, then two shuffles (destinations, duplicates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths
from ..operators import dedupe, resolve, views


def review(files: DataFrame, config: Config) -> DataFrame:
    """files: source_path, size_bytes, scan_ord and what extraction found (m_title, m_author, m_year, subject).
    Returns the review's rows, as views, with scan_ord."""
    books = resolve.with_fields(files, config.known_junk_tags).withColumn("format", paths.file_format(F.col("source_path")))
    books = resolve.with_destination(resolve.categorised(books, config), config)
    books = dedupe.distinct_destinations(books)
    flat = books.withColumns({"_t": F.col("title"), "_a": F.col("author"), "title": F.col("title.value"), "author": F.col("author.value")})
    found = dedupe.duplicates(flat).withColumns({"title": F.col("_t"), "author": F.col("_a")}).drop("_t", "_a")
    return views.book_views(resolve.with_status(found)) if "scan_ord" not in files.columns else _with_order(resolve.with_status(found))


def _with_order(books: DataFrame) -> DataFrame:
    seen = views.book_views(books).columns
    return books.withColumns({"id": F.col("source_path"), "old_filename": paths.base_name(F.col("source_path"))}).select(*seen, "scan_ord")


def warnings(reviewed: DataFrame) -> DataFrame:
    """Rows whose category was not declared."""
    return reviewed.where("category_warning <> ''").select(F.current_timestamp().alias("timestamp"), "source_path", "category", "subcategory", F.col("category_warning").alias("warning"))
