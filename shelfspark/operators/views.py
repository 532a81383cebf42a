"""Projections, filters and selections of the review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths, rules
from .dedupe import LIKELY, NOT, POSSIBLE
from .resolve import HEURISTIC, METADATA, PARTIAL, SOURCES, UNRESOLVED, sourced, uncategorised

#: What the status filter offers, in order.
CHIPS = ("All", PARTIAL, "duplicates", "uncategorized", HEURISTIC, METADATA)


def book_views(books: DataFrame) -> DataFrame:
    """What a reviewer sees; id is the source path."""
    return books.select(
        F.col("source_path").alias("id"), "source_path", paths.base_name(F.col("source_path")).alias("old_filename"), "format", "size_bytes", "title", "author", "year", "subject",
        "category", "subcategory", "category_manual", "category_warning", "dest_path", "duplicate_group_id", "duplicate_status", "status",
    )


def books_from_views(views: DataFrame) -> DataFrame:
    """The way back: status, destination and warning are dropped, unknown names become the lowest of their kind."""
    known = lambda f: sourced(F.col(f"{f}.value"), F.when(F.col(f"{f}.source").isin(*SOURCES), F.col(f"{f}.source")).otherwise(UNRESOLVED)).alias(f)
    duplicate = F.when(F.col("duplicate_status").isin(POSSIBLE, LIKELY), F.col("duplicate_status")).otherwise(NOT)
    return views.select("source_path", "format", "size_bytes", known("title"), known("author"), known("year"), "subject", "category", "subcategory", "category_manual", "duplicate_group_id", duplicate.alias("duplicate_status"))


def matches_chip(chip: str) -> Column:
    if chip.lower() == "all":
        return F.lit(True)
    if chip == "duplicates":
        return F.col("duplicate_status") != NOT
    if chip == "uncategorized":
        return uncategorised(F.col("category"))
    return F.col("status") == chip


def matches_query(query: str) -> Column:
    """Blank matches all; otherwise the query as typed, without case, in title, author or file name."""
    if not query.strip():
        return F.lit(True)
    inside = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    return inside(F.col("title.value")) | inside(F.col("author.value")) | inside(F.col("old_filename"))


def visible(views: DataFrame, chip: str = "All", query: str = "") -> DataFrame:
    return views.where(matches_chip(chip) & matches_query(query))


def selected(views: DataFrame, checked: DataFrame, chip: str = "All", query: str = "") -> DataFrame:
    """Visible rows whose id is in checked (id)."""
    return visible(views, chip, query).join(checked.select("id").distinct(), "id", "left_semi")


def all_checked(views: DataFrame, checked: DataFrame) -> DataFrame:
    """One row, all_checked: there are rows and every one is checked."""
    marked = views.select("id").join(checked.select("id").distinct().withColumn("_on", F.lit(True)), "id", "left")
    return marked.agg((F.coalesce(F.bool_and(F.col("_on").isNotNull()), F.lit(False))).alias("all_checked"))


def to_apply(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be moved, and rows that are skipped for want of a title."""
    return views.where(F.col("status") != UNRESOLVED), views.where(F.col("status") == UNRESOLVED)


def with_results(views: DataFrame, results: DataFrame) -> DataFrame:
    """results: source_path, ok, skipped, error."""
    return views.join(results.select("source_path", "ok", "skipped", "error"), "source_path", "left")


def destinations(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame(rules.destinations(config), "category string, subcategory string").orderBy("category", "subcategory")


def known_destination(views: DataFrame, leaves: DataFrame) -> DataFrame:
    """Adds known_destination: whether the row's category and subcategory can be picked.  leaves is as large as the configuration."""
    marked = leaves.select("category", "subcategory").distinct().withColumn("_d", F.lit(True))
    return views.join(marked, ["category", "subcategory"], "left").withColumn("known_destination", F.col("_d").isNotNull()).drop("_d")


def replaced(views: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of changed instead of those with their source path."""
    return views.join(changed.select("source_path"), "source_path", "left_anti").unionByName(changed.select(*views.columns))
