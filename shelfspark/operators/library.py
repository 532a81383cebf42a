"""The library: files already in place, the scan cache, cover overrides, shelves and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from .resolve import FIELDS, fallback

NO_SUBCATEGORY = "(No subcategory)"
#: Change either to make every cached row stale.
COVER_VERSION, METADATA_VERSION = 1, 1
KEY = ["source_path", "mtime_ns", "size"]


def with_folders(files: DataFrame, library: str) -> DataFrame:
    return files.withColumn("_f", paths.library_folders(F.col("source_path"), library)).withColumns({"category": F.col("_f.category"), "subcategory": F.col("_f.subcategory")}).drop("_f")


def _valid(cache: DataFrame, cover_version: int, metadata_version: int) -> DataFrame:
    current = (F.coalesce("cover_version", F.lit(0)) == cover_version) & (F.coalesce("metadata_version", F.lit(0)) == metadata_version)
    return cache.where(current)


def cache_hits(files: DataFrame, cache: DataFrame, cover_version: int = COVER_VERSION, metadata_version: int = METADATA_VERSION) -> DataFrame:
    """Cached rows of files (source_path, mtime_ns, size) that have not changed."""
    return _valid(cache, cover_version, metadata_version).join(files.select(*KEY), KEY, "left_semi")


def cache_misses(files: DataFrame, cache: DataFrame, cover_version: int = COVER_VERSION, metadata_version: int = METADATA_VERSION) -> DataFrame:
    """Files to extract again."""
    return files.join(_valid(cache, cover_version, metadata_version).select(*KEY), KEY, "left_anti")


def cache_kept(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Without rows of files that are gone."""
    return cache.join(files.select("source_path"), "source_path", "left_semi")


def cache_next(cache: DataFrame, files: DataFrame, extracted: DataFrame) -> DataFrame:
    """The cache after a scan.  extracted: rows of the cache's columns and ok; failures are not kept, and a failure's old
    row stays stale."""
    new = extracted.where("ok").select(*cache.columns)
    old = cache_kept(cache, files).join(new.select("source_path"), "source_path", "left_anti")
    return old.unionByName(new)


def filled(extracted: DataFrame, junk_tags: list[str]) -> DataFrame:
    """title, author and year with what the file name gives where they are empty; also for files that failed."""
    out = extracted.withColumn("_h", text.parse_stem(paths.stem(F.col("source_path")), junk_tags))
    return out.withColumns({f: fallback(F.col(f), F.col(f"_h.{f}")) for f in FIELDS}).drop("_h")


def with_overrides(files: DataFrame, overrides: DataFrame, page_covers: DataFrame) -> DataFrame:
    """files: source_path, cover_path.  overrides: source_path, type, page, image_path.  page_covers: source_path, page,
    cover_path of the pages that could be read.  An override whose page cannot be read leaves no cover."""
    o = overrides.select("source_path", F.col("type").alias("_type"), F.col("page").alias("_page"), F.col("image_path").alias("_image"))
    p = page_covers.select("source_path", F.col("page").alias("_page"), F.col("cover_path").alias("_cover"))
    out = files.join(o, "source_path", "left").join(p, ["source_path", "_page"], "left")
    cover = F.when(F.col("_type") == "custom", F.coalesce("_image", F.lit(""))).when(F.col("_type") == "embedded", F.coalesce("_cover", F.lit(""))).otherwise(F.col("cover_path"))
    names = list(dict.fromkeys([*files.columns, "cover_overridden"]))
    return out.withColumns({"cover_path": cover, "cover_overridden": F.col("_type").isNotNull()}).select(*names)


def categories(books: DataFrame) -> DataFrame:
    """Distinct non-empty categories, in byte order."""
    return books.where("category <> ''").select("category").distinct().orderBy("category")


def subcategories(books: DataFrame, category: str = "") -> DataFrame:
    """Distinct non-empty subcategories, in the order of a reader's language."""
    inside = books.where(F.col("category") == category) if category else books
    return inside.where("subcategory <> ''").select("subcategory").distinct().orderBy(F.collate("subcategory", "UNICODE"))


def search(books: DataFrame, query: str = "", category: str = "", subcategory: str = "") -> DataFrame:
    """Equal category and subcategory, and the trimmed query within title, author, category or subcategory."""
    if category:
        books = books.where(F.col("category") == category)
    if subcategory:
        books = books.where(F.col("subcategory") == subcategory)
    q = query.strip().lower()
    if q:
        found = F.lit(False)
        for c in ("title", "author", "category", "subcategory"):
            found = found | F.contains(F.lower(c), F.lit(q))
        books = books.where(found)
    return books


def _sort_key(sort_by: str):
    # in the order of a reader's language; equal keys keep the order of source_path
    return F.collate(F.col(sort_by), "UNICODE")


def shelves(books: DataFrame, sort_by: str = "title") -> DataFrame:
    """shelf, place, and the book's columns: books by subcategory, in order within their shelf.

    Flat rows rather than nested ones, dealt to tasks by ranges of shelf and order and numbered from the counts of earlier ranges,
    so that no shelf has to fit a task.  Categories merge unless filtered before."""
    if sort_by not in ("title", "author", "year"):
        raise ValueError("sort_by must be title, author or year")
    named = books.withColumn("shelf", F.when(F.col("subcategory") == "", NO_SUBCATEGORY).otherwise(F.col("subcategory")))
    parts = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [_sort_key(sort_by), F.col("source_path")]
    ranged = named.repartitionByRange(parts, "shelf", *order).withColumn("_range", F.spark_partition_id())
    counts = ranged.groupBy("shelf", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shelf").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shelf", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shelf", "_range").orderBy(*order))
    placed = ranged.withColumn("_within", within).join(counts, ["shelf", "_range"])
    placed = placed.withColumn("place", (F.col("_before") + F.col("_within")).cast("int")).select(*named.columns, "place")
    return placed.orderBy(F.collate("shelf", "UNICODE"), "place")


def shelf_counts(books: DataFrame) -> DataFrame:
    named = books.withColumn("shelf", F.when(F.col("subcategory") == "", NO_SUBCATEGORY).otherwise(F.col("subcategory")))
    return named.groupBy("shelf").agg(F.count("*").alias("books"))
