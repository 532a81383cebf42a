"""Cover files: written by the tasks that have the bytes, named by a hash of the book's path."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Extensions by content type.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif"}


def file_name(source_path: str, content_type: str, suffix: str = "") -> str:
    return hashlib.sha256(source_path.encode()).hexdigest() + suffix + EXTENSIONS.get(content_type, ".img")


def url(name: str, data: bytes) -> str:
    """The version makes a changed cover a new address."""
    return f"/covers/{name}?v={hashlib.sha256(data).hexdigest()[:8]}"


def write(folder: str, source_path: str, data: bytes, content_type: str, suffix: str = "") -> str:
    os.makedirs(folder, exist_ok=True)
    name = file_name(source_path, content_type, suffix)
    part = os.path.join(folder, f".{name}.{os.getpid()}")
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, os.path.join(folder, name))  # a task that runs twice leaves the same file
    return url(name, data)


def write_custom(folder: str, source_path: str, data: bytes, content_type: str) -> str:
    return write(folder, source_path, data, content_type, "-custom")


def write_candidate(folder: str, source_path: str, page: int, data: bytes, content_type: str) -> str:
    return write(folder, source_path, data, content_type, f"-p{page}")


def ensure(folder: str, source_path: str, data: bytes, content_type: str) -> str:
    """Like write, but leaves a file that is there."""
    name = file_name(source_path, content_type)
    return url(name, data) if os.path.exists(os.path.join(folder, name)) else write(folder, source_path, data, content_type)


def written_covers(covers: DataFrame, folder: str) -> DataFrame:
    """covers: source_path, cover, content_type.  source_path and cover_path ('' without a cover).  folder must be one that all
    tasks share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [write(folder, p, bytes(c), t) if c else "" for p, c, t in zip(b["source_path"], b["cover"], b["content_type"], strict=True)]
            yield pd.DataFrame({"source_path": b["source_path"], "cover_path": paths})

    return covers.select("source_path", "cover", "content_type").mapInPandas(run, "source_path string, cover_path string")
