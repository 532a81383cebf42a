"""Fields with their provenance, row status, and the edits of a reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UNCATEGORIZED, Config
from ..functions import paths, rules, text

UNRESOLVED, METADATA, HEURISTIC, EDITED, PARTIAL = "Unresolved", "Metadata", "Heuristic", "Edited", "Partial"
SOURCES = (UNRESOLVED, METADATA, HEURISTIC, EDITED)
FIELDS = ("title", "author", "year")


def sourced(value: Column, source: Column | str) -> Column:
    return F.struct(value.alias("value"), (F.lit(source) if isinstance(source, str) else source).alias("source"))


def resolved(metadata: Column, heuristic: Column) -> Column:
    """struct(value, source): metadata, else heuristic, else unresolved."""
    m, h = F.coalesce(metadata, F.lit("")), F.coalesce(heuristic, F.lit(""))
    return F.when(m != "", sourced(m, METADATA)).when(h != "", sourced(h, HEURISTIC)).otherwise(sourced(F.lit(""), UNRESOLVED))


def fallback(metadata: Column, heuristic: Column) -> Column:
    """The same without provenance."""
    m = F.coalesce(metadata, F.lit(""))
    return F.when(m != "", m).otherwise(F.coalesce(heuristic, F.lit("")))


def status(title: Column, author: Column, year: Column, manual_category: Column) -> Column:
    """What a row's sources say of it, as opposed to its values."""
    every = [title["source"], author["source"], year["source"]]
    some = lambda s: (every[0] == s) | (every[1] == s) | (every[2] == s)
    return (
        F.when(title["source"] == UNRESOLVED, UNRESOLVED)
        .when((author["source"] == UNRESOLVED) | (year["source"] == UNRESOLVED), PARTIAL)
        .when(manual_category | some(EDITED), EDITED)
        .when(some(HEURISTIC), HEURISTIC)
        .otherwise(METADATA)
    )


def with_fields(files: DataFrame, junk_tags: list[str]) -> DataFrame:
    """files: source_path and m_title, m_author, m_year, subject ('' or null if extraction found nothing).
    Adds title, author, year as struct(value, source), and drops the m_ columns."""
    out = files.withColumn("_h", text.parse_stem(paths.stem(F.col("source_path")), junk_tags))
    out = out.withColumns({f: resolved(F.col(f"m_{f}"), F.col(f"_h.{f}")) for f in FIELDS})
    return out.withColumn("subject", F.coalesce("subject", F.lit(""))).drop("_h", *[f"m_{f}" for f in FIELDS])


def categorised(books: DataFrame, config: Config) -> DataFrame:
    """Sets category, subcategory and category_warning; rows with category_manual keep what they have."""
    have = set(books.columns)
    old = {c: F.col(c) if c in have else F.lit("") for c in ("category", "subcategory", "category_warning")}
    manual = F.col("category_manual") if "category_manual" in have else F.lit(False)
    got = rules.categorise(config, F.col("source_path"), F.col("title.value"), F.col("author.value"), F.col("subject"))
    kept = F.struct(*[old[c].alias(n) for c, n in (("category", "category"), ("subcategory", "subcategory"), ("category_warning", "warning"))])
    out = books.withColumn("_c", F.when(manual, kept).otherwise(got))
    out = out.withColumns({"category": F.col("_c.category"), "subcategory": F.col("_c.subcategory"), "category_warning": F.col("_c.warning"), "category_manual": manual})
    return out.drop("_c")


def with_destination(books: DataFrame, config: Config) -> DataFrame:
    general = config.general
    path = paths.destination(F.col("source_path"), F.col("title.value"), F.col("year.value"), F.col("author.value"), F.col("category"), F.col("subcategory"), general.library_folder, general.filename_format)
    return books.withColumn("dest_path", path)


def with_status(books: DataFrame) -> DataFrame:
    return books.withColumn("status", status(F.col("title"), F.col("author"), F.col("year"), F.col("category_manual")))


def recomputed(books: DataFrame, config: Config) -> DataFrame:
    """After an edit: an edited title is formatted, then category and destination are found again.  Paths are not made
    distinct and duplicates are not looked for again."""
    title = F.when(F.col("title.source") == EDITED, sourced(text.format_title(F.col("title.value"), config.hyphen_exceptions), EDITED)).otherwise(F.col("title"))
    return with_status(with_destination(categorised(books.withColumn("title", title), config), config))


def edited(books: DataFrame, field: str, value: Column) -> DataFrame:
    return books.withColumn(field, sourced(value, EDITED))


def swapped(books: DataFrame) -> DataFrame:
    """Title and author change places; both count as edited."""
    return books.withColumns({"title": sourced(F.col("author.value"), EDITED), "author": sourced(F.col("title.value"), EDITED)})


def uncategorised(category: Column) -> Column:
    return category == UNCATEGORIZED
