"""Listing of ebook files.

The file readers of Spark skip names that start with a dot or an underscore, and such names are common among ebooks, so
folders are walked on the driver.  A listing is small beside the files: names, sizes and times.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import scan_order
from ..schema import LISTING

EXTENSIONS = (".epub", ".pdf", ".mobi", ".azw3")
#: Files that go to one task of an extraction.
FILES_PER_TASK = 64


def walk(root: str) -> Iterator[str]:
    """Ebook files below root, in depth-first, lexical order.  An unreadable folder inside is passed over; root itself must be
    readable."""
    with os.scandir(root) as found:
        entries = sorted(found, key=lambda e: e.name)
    for entry in entries:
        if entry.is_dir(follow_symlinks=False):
            try:
                yield from walk(entry.path)
            except OSError:
                continue
        elif os.path.splitext("x" + entry.name)[1].lower() in EXTENSIONS:
            yield entry.path


def _row(path: str) -> tuple[str, int, int]:
    try:
        s = os.stat(path)
        return path, s.st_size, s.st_mtime_ns
    except OSError:
        return path, 0, 0


def listing(spark: SparkSession, root: str) -> DataFrame:
    """source_path, size_bytes, mtime_ns (of a file that cannot be asked, zeros), scan_ord."""
    rows = [_row(p) for p in walk(root)]
    df = spark.createDataFrame(rows, LISTING).withColumn("scan_ord", scan_order(F.col("source_path")))
    return df.repartition(max(1, -(-len(rows) // FILES_PER_TASK)))


def check_folders(working: str, library: str, log: str) -> list[str]:
    """What is wrong; the library and log folders are made if they are missing."""
    out = []
    if not working:
        out.append("working folder is not set")
    elif not os.path.isdir(working):
        out.append(f"working folder {working} is not a folder")
    for name, path in (("library", library), ("log", log)):
        if not path:
            out.append(f"{name} folder is not set")
            continue
        try:
            os.makedirs(path, exist_ok=True)
        except OSError as e:
            out.append(f"{name} folder {path}: {e}")
    return out
