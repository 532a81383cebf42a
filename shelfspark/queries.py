"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows.

No table holds ebooks, so each query derives its files, logs or caches from columns of a table by expressions that
both dialects read alike; the derivations are the constants in capitals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config, General, Rule
from .functions import paths, rules, text
from .operators import dedupe, library, oplog, resolve, views
from .plans import review
from .sources import extract, samples

TAGS = ["OceanofPDF.com", "libgen.li"]
HYPHENS = ["Red-Widget", "Blue-Bolt"]
LIBRARY = "/library"
CONFIG = Config(
    General(library_folder=LIBRARY),
    TAGS,
    HYPHENS,
    {"Fiction": ["Sci-Fi", "en"], "Technology": ["Economy", "Small", "de"], "Languages": ["fr", "es", "Small"], "Uncategorized": []},
    [
        Rule("author", "ann lee", "Fiction", "Sci-Fi"),
        Rule("filename", r"(?i)\bgear\b|ring_", "Technology", "Gears"),
        Rule("title", "^red w", "Crafts", "Red"),
        Rule("title", "([unclosed", "Never", ""),
        Rule("metadata_subject", "promo", "Technology", ""),
        Rule("publisher", "x", "Never", ""),
    ],
)

# --- derivations, in both dialects ---

STEM = """case p_partkey % 6
 when 0 then replace(p_name, ' ', '_') || '_(' || (1990 + p_size) || ', ' || p_brand || ')'
 when 1 then '_OceanofPDF.com_' || replace(p_name, ' ', '_') || '_-_Jane_Doe'
 when 2 then 'John Smith, Jane Doe - ' || p_name || ' (' || (1950 + p_size) || ') - libgen.li'
 when 3 then p_name || ' - Ann Lee;Bob Ray libgen.li'
 when 4 then replace(p_name, ' ', '+') || '{' || p_partkey || '}[2003 ed]'
 else 'Ann Lee - ' || p_name || ';' end"""
PATH = f"'/inbox/' || lower(p_type) || '/' || ({STEM}) || case p_size % 3 when 0 then '.epub' when 1 then '.PDF' else '.mobi' end"
M_TITLE = "case when p_size % 3 = 0 then p_name else '' end"
M_AUTHOR = "case when p_size % 5 = 0 then 'Ann Lee' when p_size % 5 = 1 then 'Bob Ray' else '' end"
M_YEAR = "case when p_size % 4 = 1 then '' || (1950 + p_size) else '' end"
FORMAT = "case p_size % 4 when 0 then 'epub' when 1 then 'pdf' when 2 then 'mobi' else 'azw3' end"
SIZE = "cast(round(p_retailprice * 1000) as bigint)"
LONG_TITLE = "case when p_partkey % 4 = 0 then '' when p_partkey % 4 = 1 then repeat(p_name || ' ', 30) else p_name end"
#: Some files are named by nothing but a number in brackets.
UNTITLED_PATH = f"case when p_partkey % 13 = 0 then '/inbox/(' || p_partkey || ').pdf' else {PATH} end"
ORDER_BATCH = "o_custkey % 400"
SPLIT_CATEGORY, SPLIT_SUB = "case when p_size % 4 = 0 then '' else p_type end", "case when p_size % 4 = 0 or p_size % 5 = 0 then '' else p_brand end"
SPLIT_PATH = f"'/home/x//library/' || ({SPLIT_CATEGORY}) || case when p_size % 2 = 0 then '/' else chr(92) end || ({SPLIT_SUB}) || '/' || p_name || '.epub'"
DISPLAY_PATH = "'/a.b/' || case p_partkey % 5 when 0 then '.' || p_brand when 1 then p_name || '.tar.gz' when 2 then p_name else p_name || '.epub' end || case when p_size % 9 = 0 then '/' else '' end"
BOOK_AUTHOR, BROKEN = "p_brand || case when p_size % 2 = 0 then ';Ann Lee' else '' end", "p_size % 10 = 7 and p_size % 4 <> 1"
EVENT_BATCH = "'20240101-' || (user_id % 7) || case when event_type = 'error' then 'x' when user_id % 11 = 0 then ' ' else '' end"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, path: str = PATH) -> DataFrame:
    """Files with what extraction found in them."""
    return _read(spark, sf_dir, "part").selectExpr("p_partkey as scan_ord", f"{path} as source_path", f"{SIZE} as size_bytes", f"{M_TITLE} as m_title", f"{M_AUTHOR} as m_author", f"{M_YEAR} as m_year", "p_type as subject")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr("p_partkey", "p_name as title", "p_brand as author", f"{FORMAT} as format", f"{SIZE} as size_bytes")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey as log_ord", f"'b' || ({ORDER_BATCH}) as batch_id", "o_orderdate as timestamp", "'move' as op_type", "'/old/' || o_orderkey as old_path", "'/new/' || o_orderkey as new_path", "o_orderstatus = 'F' as undone")


def dup_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicates(_catalogue(spark, sf_dir)).select("p_partkey", "duplicate_group_id", "duplicate_status")


def review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows under the chip of duplicates and a query."""
    return views.visible(_review(spark, sf_dir), "duplicates", "RING").select("source_path", "status", "duplicate_status")


def stem_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").selectExpr("p_partkey", f"{STEM} as stem")
    return part.select("p_partkey", text.parse_stem(F.col("stem"), TAGS).alias("h")).select("p_partkey", "h.title", "h.author", "h.year")


def title_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "case p_partkey % 4 when 0 then replace(p_name, ' ', '-') when 1 then 'the_' || replace(p_name, ' ', '_') || '_of_a_' || p_type when 2 then 'on ' || p_name || ' in iOS-' || p_brand else upper(p_name) || ' and' end"
    return _read(spark, sf_dir, "part").selectExpr("p_partkey", f"{t} as t").select("p_partkey", text.format_title(F.col("t"), HYPHENS).alias("title"))


def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").selectExpr("p_partkey", "p_name || substr('. ;.; .', 1, p_size % 8) as t", "p_brand || ' ;' || p_type || ';x' as a", "'v' || p_size || ' (' || (1480 + p_partkey % 700) || ')' as y")
    return part.select("p_partkey", text.clean_field(F.col("t")).alias("title"), text.author_separators(F.col("a")).alias("author"), text.extract_year(F.col("y")).alias("year"), text.duplicate_key(F.concat("a", "y")).alias("dup_key"))


def rule_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = resolve.with_fields(_files(spark, sf_dir), TAGS)
    return resolve.categorised(books, CONFIG).select("scan_ord", "category", "subcategory", "category_warning")


def subject_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their text as title, their language as subject and their source as author."""
    docs = _read(spark, sf_dir, "documents")
    got = rules.categorise(CONFIG, F.concat(F.lit("/x/"), "source"), F.coalesce("text", F.lit("")), F.col("source"), F.col("lang"))
    return docs.select("doc_id", got.alias("c")).select("doc_id", "c.category", "c.subcategory")


def provenance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = resolve.with_fields(_files(spark, sf_dir), TAGS).withColumn("category_manual", F.col("scan_ord") % 17 == 0)
    flat = [F.col(f"{f}.{k}").alias(f"{f}_{k}") for f in resolve.FIELDS for k in ("value", "source")]
    return resolve.with_status(books).select("scan_ord", *flat, "status")


def dest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").selectExpr("p_partkey", "'/x/' || p_partkey || '.Epub' as source_path", f"{LONG_TITLE} as title", "case when p_size % 2 = 0 then p_brand else '' end as author", "case when p_size % 3 = 0 then '' || (1950 + p_size) else '' end as year", "p_type as category", "case when p_size % 5 = 0 then '' else p_brand end as sub")
    got = paths.destination(*(F.col(c) for c in ("source_path", "title", "year", "author", "category", "sub")), library=LIBRARY, template="{title} ({year}) - {author}")
    return part.select("p_partkey", got.alias("dest_path"))


def dest_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").selectExpr("p_partkey as scan_ord", "case when p_partkey % 9 = 0 then '' else '/library/' || p_type || '/' || p_name || '.epub' end as dest_path")
    return dedupe.distinct_destinations(part)


def _review(spark: SparkSession, sf_dir: str, path: str = PATH) -> DataFrame:
    return review.review(_files(spark, sf_dir, path), CONFIG)


def scan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: fields, categories, destinations made distinct, duplicates and status of every file."""
    return _review(spark, sf_dir).select("source_path", "format", F.col("title.value").alias("title"), F.col("author.value").alias("author"), F.col("year.value").alias("year"), "category", "subcategory", "dest_path", "duplicate_status", "status")


def recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, every seventh title edited, then recomputed."""
    books = resolve.with_fields(_files(spark, sf_dir), TAGS).withColumns({"category_manual": F.lit(False), "_old": F.col("title")})
    books = resolve.edited(books, "title", F.concat(F.lit("the_"), F.col("title.value"), F.lit("-of-a-kind")))
    books = books.withColumn("title", F.when(F.col("scan_ord") % 7 == 0, F.col("title")).otherwise(F.col("_old"))).drop("_old")
    return resolve.recomputed(books, CONFIG).select("scan_ord", F.col("title.value").alias("title"), "status", "category")


def apply_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can be moved, and rows without a title."""
    ready, skipped = views.to_apply(_review(spark, sf_dir, UNTITLED_PATH))
    return ready.select("source_path", F.lit(False).alias("skipped")).unionByName(skipped.select("source_path", F.lit(True).alias("skipped")))


def known_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = views.known_destination(rules_view(spark, sf_dir), views.destinations(spark, CONFIG))
    return got.groupBy("category", "subcategory", "known_destination").agg(F.count("*").alias("n"))


def rules_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.categorised(resolve.with_fields(_files(spark, sf_dir), TAGS), CONFIG).select("scan_ord", "category", "subcategory")


def batch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = oplog.remaining(oplog.batches(_log(spark, sf_dir)))
    return got.select("batch_id", text.batch_date(F.col("timestamp")).alias("first_day"), "entry_count", "undone_count", "remaining_count", "first_ord")


def batch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = oplog.batch_views(_log(spark, sf_dir))
    return got.select("batch_id", "timestamp_text", F.array_join(F.transform("entries", lambda e: F.concat(e["log_ord"].cast("string"), F.when(e["undone"], "-").otherwise("+"))), ",").alias("entries"))


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = oplog.batch_rows(_log(spark, sf_dir))
    return got.select("log_ord", "batch_id", text.batch_date(F.col("batch_timestamp")).alias("first_day"), "entry_count", "undone_count", "undone")


def batch_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _read(spark, sf_dir, "events").selectExpr("event_id as log_ord", f"{EVENT_BATCH} as batch_id")
    return oplog.next_batch_id(log, "20240101")


def undo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as events on the moves of their orders; flag R is an undo, N an event on a whole batch."""
    log = _log(spark, sf_dir)
    line = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    whole = "l_returnflag = 'N' and l_linenumber = 1"
    events = line.selectExpr("l_orderkey * 10 + l_linenumber as log_ord", f"'b' || ({ORDER_BATCH}) as batch_id", "l_quantity > 25 as undone", f"case when {whole} then null else '/old/' || l_orderkey end as old_path", f"case when {whole} then null else '/new/' || l_orderkey end as new_path")
    return oplog.folded(log, events).select("log_ord", "batch_id", "undone")


def undo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = oplog.to_undo(_log(spark, sf_dir), "b7")
    return got.withColumn("place", F.row_number().over(Window.orderBy(F.col("log_ord").desc()))).select("place", "old_path", "new_path")


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files now, and the cache of an earlier scan."""
    docs = _read(spark, sf_dir, "documents").selectExpr("'/library/' || lang || '/' || source || '/' || doc_id || '.epub' as source_path", "doc_id * 1000 as mtime_ns", "n_chars as size", "doc_id")
    files = docs.select("source_path", F.expr("case when doc_id % 10 = 8 then mtime_ns + 1 else mtime_ns end").alias("mtime_ns"), F.expr("case when doc_id % 10 = 4 then size + 1 else size end").alias("size"))
    cache = docs.selectExpr(
        "case when doc_id % 10 in (3, 5) then source_path || '.gone' else source_path end as source_path", "mtime_ns", "size", "'t' || doc_id as title", "'a' as author", "'' as year", "'' as category", "'' as subcategory", "'' as cover_path", "false as cover_overridden",
        "cast(case when doc_id % 10 = 6 then 0 else 1 end as int) as cover_version", "cast(case when doc_id % 10 = 7 then null else 1 end as int) as metadata_version",
    )
    return files, cache


def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, cache = _cache(spark, sf_dir)
    return library.cache_hits(files, cache).select("source_path", "title")


def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, cache = _cache(spark, sf_dir)
    return library.cache_misses(files, cache).select("source_path", "size")


def cache_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, cache = _cache(spark, sf_dir)
    return library.cache_kept(cache, files).select("source_path", "title")


def cache_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, cache = _cache(spark, sf_dir)
    missed = library.cache_misses(files, cache)
    new = missed.select("source_path", "mtime_ns", "size", F.lit("new").alias("title"), *[F.lit("").alias(c) for c in ("author", "year", "category", "subcategory", "cover_path")], F.lit(False).alias("cover_overridden"), F.lit(1).alias("cover_version"), F.lit(1).alias("metadata_version"), (F.col("size") % 4 != 0).alias("ok"))
    return library.cache_next(cache, files, new).select("source_path", "title", "size")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr("'/library/' || p_partkey as source_path", "p_name as title", "p_brand as author", "'' || (1950 + p_size) as year", "case when p_size % 6 = 0 then '' else p_type end as category", "case when p_size % 7 = 0 then '' else p_brand end as subcategory")


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.shelves(_books(spark, sf_dir), "year").select("shelf", "place", "source_path")


def shelf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.shelf_counts(_books(spark, sf_dir))


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.search(_books(spark, sf_dir), "  RING ", "ECONOMY").select("source_path", "title")


def library_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.categories(_books(spark, sf_dir))


def library_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.subcategories(_books(spark, sf_dir), "SMALL")


def cover_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "part").selectExpr("'/library/' || p_partkey as source_path", "'/covers/' || p_partkey as cover_path")
    overrides = _read(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("'/library/' || p_partkey as source_path", "case when p_partkey % 2 = 0 then 'custom' else 'embedded' end as type", "cast(p_size as int) as page", "'/custom/' || p_partkey as image_path")
    pages = _read(spark, sf_dir, "part").where("p_size < 25").selectExpr("'/library/' || p_partkey as source_path", "cast(p_size as int) as page", "'/pages/' || p_partkey || '-' || p_size as cover_path")
    return library.with_overrides(files, overrides, pages).select("source_path", "cover_path", "cover_overridden")


def path_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/library/"), F.regexp_replace("url", "^[a-z]+://|[?#].*", "")).alias("p"))
    got = paths.library_folders(F.col("p"), LIBRARY)
    return pages.select("page_id", got["category"].alias("category"), got["subcategory"].alias("subcategory"), paths.base_name(F.col("p")).alias("name"), paths.file_format(F.col("p")).alias("format"), paths.stem(F.col("p")).alias("stem"))


def cover_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "image/png").when(F.col("doc_id") % 3 == 1, "image/jpeg").otherwise("image/bmp")
    return docs.select("doc_id", text.cover_name(F.col("source"), kind).alias("file"), text.content_version(F.encode("text", "UTF-8")).alias("version"))


def review_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are checked and visible."""
    seen = views.book_views(_review(spark, sf_dir))
    checked = _read(spark, sf_dir, "part").selectExpr(f"{PATH} as id", "p_size < 25 as checked").where("checked")
    return views.selected(seen, checked, "Partial", "ring").select(F.col("id").alias("source_path"), "status")


def review_all_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all rows are checked, with every row checked and with some."""
    seen = _read(spark, sf_dir, "part").selectExpr("'' || p_partkey as id")
    some = _read(spark, sf_dir, "part").where("p_size < 25").selectExpr("'' || p_partkey as id")
    return views.all_checked(seen, seen).select(F.lit("every").alias("checked"), "all_checked").unionByName(views.all_checked(seen, some).select(F.lit("some").alias("checked"), "all_checked"))


def swap_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = resolve.swapped(resolve.with_fields(_files(spark, sf_dir), TAGS)).withColumn("category_manual", F.lit(False))
    return resolve.with_status(books).select("scan_ord", F.col("title.value").alias("title"), F.col("author.value").alias("author"), F.col("title.source").alias("title_source"), "status")


def dest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations as they are displayed, with both kinds of separators."""
    part = _read(spark, sf_dir, "part").selectExpr("p_partkey", f"{SPLIT_PATH} as p", f"{SPLIT_CATEGORY} as category", f"{SPLIT_SUB} as sub")
    got = paths.split_destination(F.col("p"), F.col("category"), F.col("sub"))
    return part.select("p_partkey", got.alias("d")).select("p_partkey", "d.prefix", "d.folder", "d.name")


def display_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "part").selectExpr("p_partkey", f"{DISPLAY_PATH} as p")
    return names.select("p_partkey", paths.display_stem(F.col("p")).alias("stem"))


def apply_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with what became of them; some have no result yet."""
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey as scan_ord", "'/inbox/' || p_partkey as source_path")
    results = _read(spark, sf_dir, "part").where("p_size < 40").selectExpr("'/inbox/' || p_partkey as source_path", "p_size % 3 <> 0 as ok", "p_size % 3 = 1 as skipped", "case when p_size % 3 = 0 then 'no space' else '' end as error")
    return views.with_results(rows, results).select("scan_ord", "ok", "skipped", "error")


def redo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = oplog.to_redo(_log(spark, sf_dir), "b7")
    return got.withColumn("place", F.row_number().over(Window.orderBy("log_ord"))).select("place", "old_path", "new_path")


def warning_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings as they are listed, newest first."""
    warned = _log(spark, sf_dir).withColumnRenamed("batch_id", "message")
    got = oplog.warning_views(warned)
    return got.withColumn("place", F.row_number().over(Window.orderBy(F.col("log_ord").desc()))).select("place", "message", "timestamp_text")


def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author and year from the file where there are any, else from its name."""
    files = _files(spark, sf_dir).selectExpr("scan_ord", "source_path", "m_title as title", "m_author as author", "m_year as year")
    return library.filled(files, TAGS).select("scan_ord", "title", "author", "year")


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPUB, MOBI, AZW3 and PDF files that hold a row's metadata, and some that are cut short, read again."""
    books = _read(spark, sf_dir, "part").selectExpr(f"'/in/' || p_partkey || '.' || ({FORMAT}) as source_path", f"{FORMAT} as format", "p_name as title", f"{BOOK_AUTHOR} as author", "(1950 + p_size) || '-05-30' as date", "p_type as subject", f"{BROKEN} as broken")
    made = samples.files(books.where("not broken"))
    cut = books.where("broken").select("source_path", F.lit("%no book").cast("binary").alias("content"))
    got = extract.extracted(made.unionByName(cut), HYPHENS)
    return got.select("source_path", "ok", "title", "author", "year", "subject")


def elapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", text.elapsed(F.col("p_size") * F.col("p_size") / 4).alias("elapsed"))


_QUERIES = (
    dup_detect, review_filter, stem_parse, title_format, clean_fields, rule_categorise, subject_categorise, provenance_status, dest_path, dest_disambiguate, scan_review, recompute, apply_split, known_destinations,
    batch_list, batch_entries, batch_rows, batch_next_id, undo_fold, undo_order, cache_hit, cache_miss, cache_keep, cache_next, shelves, shelf_counts, library_search, library_categories, library_subcategories, cover_overrides, path_partition, cover_names,
    review_select, review_all_checked, swap_fields, dest_split, display_stems, apply_results, redo_order, warning_order, filled_fields, extracted_fields, elapsed_text,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
