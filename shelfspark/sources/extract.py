"""Extraction: the one place where Python reads files in tasks.

There are separate operators with and without covers, as Catalyst cannot prune a column inside Python.  A file is read by one
task and never leaves it; an error becomes a row with ok = false.  If the input has a column content, as Spark's
binaryFile source gives, that is read instead of the path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import epub, mobi, pdf
from .record import Found, Unreadable

#: Results that are handed over together, at most, and the bytes of their images and texts from which they are.
ROWS, BYTES = 1000, 16 << 20
IMAGES = (("source_path", "string"), ("page", "int"), ("image", "binary"), ("content_type", "string"))


def read_book(path: str, data: bytes, cover: bool, page_limit: int) -> Found:
    kind = path.rpartition("/")[2].rpartition(".")[2].lower()
    if kind == "epub":
        return epub.extract(data, cover)
    if kind in ("mobi", "azw3"):
        return mobi.extract(data, cover)
    if kind == "pdf":
        return pdf.extract(data, cover, page_limit)
    raise Unreadable(f"unsupported format {kind!r}")


def _bytes(row: dict) -> bytes:
    content = row.get("content")
    if content is not None:
        return content
    with open(row["source_path"], "rb") as f:
        return f.read()


def _each(batches: Iterator[pa.RecordBatch], one: Callable, kinds: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """One file at a time in memory, and results of ROWS rows or about BYTES bytes at most."""
    schema = pa.schema(kinds)
    for batch in batches:
        found, held = [], 0
        for k in range(batch.num_rows):
            for result in one({name: batch.column(name)[k].as_py() for name in batch.schema.names}):
                found.append(result)
                held += sum(len(x) for x in result if isinstance(x, str | bytes))
                if len(found) >= ROWS or held >= BYTES:
                    yield _batch(found, schema)
                    found, held = [], 0
        if found:
            yield _batch(found, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _kinds(*columns: tuple[str, str]) -> tuple[list[tuple[str, pa.DataType]], str]:
    """Columns for Arrow, and the same for Spark."""
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    return [(n, arrow[k]) for n, k in columns], ", ".join(f"{n} {k}" for n, k in columns)


def _inputs(files: DataFrame) -> DataFrame:
    return files.select("source_path", *[c for c in ("content",) if c in files.columns])


def extracted(files: DataFrame, hyphen_exceptions: list[str] = (), cover: bool = False, page_limit: int = pdf.PAGE_LIMIT) -> DataFrame:
    """source_path, ok, title, author, year, subject, error, and with cover: cover, content_type.

    Titles are cleaned and set in title case, authors cleaned; a failed file has empty fields."""
    columns = [("source_path", "string"), ("ok", "boolean"), *[(c, "string") for c in ("title", "author", "year", "subject", "error")], *([("cover", "binary"), ("content_type", "string")] if cover else [])]
    kinds, ddl = _kinds(*columns)

    def one(row):
        try:
            got, error = read_book(row["source_path"], _bytes(row), cover, page_limit), ""
        except Exception as e:  # a broken file must not end a scan
            got, error = Found(), f"{type(e).__name__}: {e}"
        yield (row["source_path"], not error, got.title, got.author, got.year, got.subject, error, got.cover, got.content_type)[: len(kinds)]

    out = _inputs(files).mapInArrow(lambda rows: _each(rows, one, kinds), ddl)
    title = text.format_title(text.clean_field(F.col("title")), list(hyphen_exceptions))
    return out.withColumns({"title": title, "author": text.author_separators(text.clean_field(F.col("author")))})


def cover_candidates(files: DataFrame, page_limit: int = pdf.PAGE_LIMIT) -> DataFrame:
    """source_path, page, image, content_type of every image on the first pages of PDFs."""

    def one(row):
        try:
            found = pdf.candidates(_bytes(row), page_limit)
        except Exception:
            found = []
        for page, image, kind in found:
            yield row["source_path"], page, image, kind

    pdfs = _inputs(files.where(F.lower("source_path").endswith(".pdf")))
    kinds, ddl = _kinds(*IMAGES)
    return pdfs.mapInArrow(lambda rows: _each(rows, one, kinds), ddl)


def page_covers(files: DataFrame) -> DataFrame:
    """files: source_path, page.  The first image on that page, for files that have one."""

    def one(row):
        try:
            found = pdf.page_cover(_bytes(row), int(row["page"]))
        except Exception:
            found = None
        if found:
            yield row["source_path"], int(row["page"]), *found

    inputs = files.select("source_path", "page", *[c for c in ("content",) if c in files.columns])
    kinds, ddl = _kinds(*IMAGES)
    return inputs.mapInArrow(lambda rows: _each(rows, one, kinds), ddl)
