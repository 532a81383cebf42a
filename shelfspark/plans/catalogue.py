"""The whole application: scans, reviews, moves, the library and its covers.  Configuration is read again by each call."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as configuration
from ..actions.moves import Ledger, Move
from ..functions.text import media_type
from ..operators import library, oplog, resolve, views
from ..sources import covers, extract, listing, state
from . import review


class Catalogue:
    def __init__(self, spark: SparkSession, config_path: str, state_folder: str, progress: Callable[[int, int], None] | None = None):
        """progress: called with (done, total) files; (0, total) when a scan starts."""
        self.spark, self.config_path, self.progress = spark, config_path, progress
        self.cover_folder = os.path.join(state_folder, "covers")
        self.cache = state.Cache(spark, os.path.join(state_folder, "library-cache"))
        self.overrides = state.Overrides(os.path.join(state_folder, "cover-overrides.json"))

    @property
    def config(self) -> configuration.Config:
        return configuration.load(self.config_path)

    def _log_file(self) -> str:
        return os.path.join(self.config.general.log_folder, "ops.jsonl")

    def ledger(self) -> Ledger:
        return Ledger(self._log_file())

    def config_status(self) -> dict:
        try:
            c = self.config
        except Exception as e:
            return {"ok": False, "error": str(e), "warnings": []}
        return {"ok": True, "error": "", "warnings": configuration.rule_warnings(c)}

    def categories(self) -> DataFrame:
        return views.destinations(self.spark, self.config)

    def _report(self, done: int, total: int) -> None:
        if self.progress:
            self.progress(done, total)

    def _dealt(self, files: DataFrame) -> DataFrame:
        """In as many tasks as the configuration allows at once; as they are if it sets no limit."""
        n = self.config.general.scan_concurrency
        return files.coalesce(n) if n else files

    def scan(self) -> DataFrame:
        """The review of the working folder, and its category warnings appended to their log."""
        c = self.config
        if wrong := listing.check_folders(c.general.working_folder, c.general.library_folder, c.general.log_folder):
            raise ValueError("; ".join(wrong))
        files = listing.listing(self.spark, c.general.working_folder)
        total = files.count()
        self._report(0, total)
        limit = c.general.pdf_cover_page_limit or 10
        found = extract.extracted(self._dealt(files), c.hyphen_exceptions, page_limit=limit).select("source_path", *[F.col(f).alias(f"m_{f}") for f in resolve.FIELDS], "subject")
        reviewed = review.review(files.join(found, "source_path"), c).orderBy("scan_ord").persist()  # files are read once
        try:
            state.append_warnings(review.warnings(reviewed), c.general.log_folder)
        except OSError:
            pass  # a scan does not fail for its warnings
        self._report(total, total)
        return reviewed

    def recompute(self, books: DataFrame) -> DataFrame:
        return resolve.recomputed(books, self.config)

    def next_batch_id(self) -> str:
        log = state.op_log(self.spark, self._log_file())
        return oplog.next_batch_id(log, datetime.now().strftime("%Y%m%d")).first()[0]

    def apply(self, rows: DataFrame) -> list[dict]:
        """rows: source_path, dest_path, status.  Unresolved rows are skipped; the others share one outcome."""
        ready, skipped = views.to_apply(rows)
        out = [{"source_path": r["source_path"], "ok": False, "skipped": True, "error": ""} for r in skipped.select("source_path").toLocalIterator()]
        moves = [Move(r["source_path"], r["dest_path"]) for r in ready.select("source_path", "dest_path").toLocalIterator()]
        if not moves:
            return out
        error = ""
        try:
            self.ledger().execute(self.next_batch_id(), moves)
        except OSError as e:
            error = str(e)
        return out + [{"source_path": m.old_path, "ok": not error, "skipped": False, "error": error} for m in moves]

    def undo_batch(self, batch_id: str) -> int:
        return self.ledger().undo(batch_id)

    def redo_batch(self, batch_id: str) -> int:
        return self.ledger().redo(batch_id)

    def _log(self) -> DataFrame:
        log = state.op_log(self.spark, self._log_file())
        rows = [(n, e["batch_id"], bool(e["undone"]), e["old_path"], e["new_path"]) for n, e in enumerate(state.lines(self.ledger().events))]
        events = self.spark.createDataFrame(rows, "log_ord bigint, batch_id string, undone boolean, old_path string, new_path string")
        return oplog.folded(log, events)

    def operation_batches(self) -> DataFrame:
        return oplog.remaining(oplog.batch_views(self._log()))

    def category_warnings(self) -> DataFrame:
        return oplog.warning_views(state.warnings_log(self.spark, os.path.join(self.config.general.log_folder, "category-warnings.jsonl")))

    def library(self) -> DataFrame:
        """Every file of the library, from the cache where it has not changed; the cache follows."""
        c = self.config
        files = listing.listing(self.spark, c.general.library_folder).withColumnRenamed("size_bytes", "size").persist()
        old = self.cache.load()
        missed = library.cache_misses(files, old).persist()
        limit = c.general.pdf_cover_page_limit or 10
        found = extract.extracted(self._dealt(missed), c.hyphen_exceptions, cover=True, page_limit=limit).persist()
        written = covers.written_covers(found, self.cover_folder)
        o = self.overrides.table(self.spark)
        wanted = missed.join(o.where("type = 'embedded'").select("source_path", "page"), "source_path")
        pages = extract.page_covers(wanted).select("source_path", "page", F.col("image").alias("cover"), "content_type").persist()
        page_paths = covers.written_covers(pages, self.cover_folder).join(pages.select("source_path", "page"), "source_path")
        new = library.filled(found.drop("cover", "content_type"), c.known_junk_tags).join(written, "source_path")
        new = library.with_overrides(new, o, page_paths).join(missed.drop("scan_ord"), "source_path")
        new = library.with_folders(new, c.general.library_folder).withColumns({"cover_version": F.lit(library.COVER_VERSION), "metadata_version": F.lit(library.METADATA_VERSION)}).persist()
        fields = ("title", "author", "year", "category", "subcategory", "cover_path", "cover_overridden")
        hits = library.cache_hits(files, old).select("source_path", *fields)
        out = files.join(hits.unionByName(new.select("source_path", *fields)), "source_path").select("source_path", *fields, "size", "scan_ord")
        out = out.orderBy("scan_ord").persist()
        out.count()  # before the cache's old version goes
        following = library.cache_next(old, files, new).persist()
        try:
            self.cache.save_if_changed(old, following)
        except OSError:
            pass  # the next scan reads the files again
        for done in (files, missed, found, pages, new, following):
            done.unpersist()
        return out

    def cover_candidates(self, source_path: str) -> list[dict]:
        """page and address of each image on the first pages of a PDF."""
        files = self.spark.createDataFrame([(source_path,)], "source_path string")
        found = extract.cover_candidates(files, self.config.general.pdf_cover_page_limit or 10).orderBy("page")
        out, seen = [], {}
        for r in found.toLocalIterator():
            seen[r["page"]] = n = seen.get(r["page"], 0) + 1
            name = r["page"] if n == 1 else f"{r['page']}-{n}"
            out.append({"page": r["page"], "cover_path": covers.write_candidate(self.cover_folder, source_path, name, bytes(r["image"]), r["content_type"])})
        return out

    def set_cover_page(self, source_path: str, page: int) -> str:
        files = self.spark.createDataFrame([(source_path, page)], "source_path string, page int")
        got = extract.page_covers(files).first()
        if got is None:
            raise ValueError(f"page {page} of {source_path} has no image")
        self.overrides.embedded(source_path, page)
        self.cache.invalidate(source_path)
        return covers.write(self.cover_folder, source_path, bytes(got["image"]), got["content_type"])

    def set_cover_image(self, source_path: str, data: bytes, content_type: str) -> str:
        path = covers.write_custom(self.cover_folder, source_path, data, content_type)
        self.overrides.custom(source_path, path)
        self.cache.invalidate(source_path)
        return path

    def set_cover_file(self, source_path: str, image_path: str) -> str:
        with open(image_path, "rb") as f:
            kind = self.spark.range(1).select(media_type(F.lit(image_path))).first()[0]
            return self.set_cover_image(source_path, f.read(), kind)

    def clear_cover(self, source_path: str) -> None:
        self.overrides.clear(source_path)
        self.cache.invalidate(source_path)

    def reset_covers(self) -> None:
        self.cache.reset()

    def scan_concurrency(self) -> int:
        """How many files are read at once: what is configured, else the cores that Spark has."""
        return self.config.general.scan_concurrency or self.spark.sparkContext.defaultParallelism

    def set_scan_concurrency(self, n: int) -> None:
        if n < 0:
            raise ValueError("concurrency cannot be negative")
        c = self.config
        c.general.scan_concurrency = n
        configuration.save(self.config_path, c)
