"""Tables that are kept between runs: the operation log, category warnings, the scan cache and cover overrides.

Logs are JSON lines in the order in which they were appended.  As Spark gives lines no number, a log is read on
the driver, line by line, and numbered; a log is as long as the moves that one person has made.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import CACHE, OP_LOG, OVERRIDE, WARNING, table

#: Longest line of a log, in bytes.
LONGEST_LINE = 1 << 20


class BadLog(ValueError):
    pass


def _time(value: str) -> datetime:
    """RFC 3339, to the microsecond."""
    head, dot, tail = value.partition(".")
    if dot:
        digits = next((i for i, c in enumerate(tail) if not c.isdigit()), len(tail))
        value = f"{head}.{tail[:digits][:6]:0<6}{tail[digits:]}"
    got = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return got.astimezone(timezone.utc) if got.tzinfo else got.replace(tzinfo=timezone.utc)


def lines(path: str) -> Iterable[dict]:
    """Objects of a JSON lines file; none if there is no file.  Empty lines are passed over, a bad one is an error."""
    if not os.path.exists(path):
        return
    with open(path, "rb") as f:
        for n, line in enumerate(f, 1):
            line = line.rstrip(b"\r\n")
            if not line:
                continue
            if len(line) >= LONGEST_LINE:
                raise BadLog(f"{path}: line {n} is too long")
            try:
                got = json.loads(line)
            except ValueError as e:
                raise BadLog(f"{path}: line {n}: {e}") from e
            if not isinstance(got, dict):
                raise BadLog(f"{path}: line {n} is no object")
            yield got


def _numbered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = table("log_ord bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    empty = {"string": "", "boolean": False, "timestamp": None}
    rows = []
    for n, x in enumerate(lines(path)):
        row = [x.get(f.name, empty[f.dataType.simpleString()]) for f in schema]
        rows.append((n, *[_time(v) if f.name == "timestamp" and v else v for f, v in zip(schema, row, strict=True)]))
    return spark.createDataFrame(rows, full)


def append_lines(path: str, rows: Iterable[dict]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        for row in rows:
            f.write(json.dumps(row, ensure_ascii=False) + "\n")


def op_log(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark, path, OP_LOG)


def warnings_log(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark, path, WARNING)


def append_warnings(warnings: DataFrame, log_folder: str) -> int:
    """Appends rows with a warning; makes no file if there are none.  An unset folder matters only if there are some."""
    rows = warnings.where("warning <> ''").select(*[f.name for f in WARNING]).toLocalIterator()
    found = [{**r.asDict(), "timestamp": r["timestamp"].strftime("%Y-%m-%dT%H:%M:%S.%fZ")} for r in rows]
    if found and not log_folder:
        raise ValueError("log folder is not set")
    if found:
        append_lines(os.path.join(log_folder, "category-warnings.jsonl"), found)
    return len(found)


class Cache:
    """The scan cache, as Parquet.  A new version is written beside the old one before it takes its place; whatever cannot be
    read counts as empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def load(self) -> DataFrame:
        try:
            with open(os.path.join(self.folder, "CURRENT"), encoding="utf-8") as f:
                got = self.spark.read.schema(CACHE).parquet(os.path.join(self.folder, f.read().strip()))
                got.limit(1).collect()
                return got
        except Exception:  # a cache may always be built again
            return self.spark.createDataFrame([], CACHE)

    def save(self, cache: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        cache.select(*CACHE.fieldNames()).write.parquet(os.path.join(self.folder, name))
        with open(os.path.join(self.folder, "CURRENT.new"), "w", encoding="utf-8") as f:
            f.write(name)
        os.replace(os.path.join(self.folder, "CURRENT.new"), os.path.join(self.folder, "CURRENT"))
        for old in os.listdir(self.folder):
            if old.startswith("v-") and old != name:
                shutil.rmtree(os.path.join(self.folder, old), ignore_errors=True)

    def save_if_changed(self, before: DataFrame, after: DataFrame) -> bool:
        names = CACHE.fieldNames()
        mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*names))).first())
        if mark(before.select(*names)) == mark(after.select(*names)):
            return False
        self.save(after)
        return True

    def invalidate(self, source_path: str) -> None:
        self.save_if_changed(old := self.load(), old.where(F.col("source_path") != source_path))

    def reset(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Overrides:
    """Cover overrides, a JSON object by path.  A file that cannot be read is an error: a choice made by hand must not be lost."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> dict[str, dict]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            got = json.load(f)
        if not isinstance(got, dict):
            raise ValueError(f"{self.path} is no object")
        return got

    def _save(self, all_: dict[str, dict]) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(all_, f, ensure_ascii=False, indent=2)
        os.replace(self.path + ".new", self.path)

    def get(self, source_path: str) -> dict | None:
        return self.load().get(source_path)

    def embedded(self, source_path: str, page: int) -> None:
        self._save(self.load() | {source_path: {"type": "embedded", "page": page}})

    def custom(self, source_path: str, image_path: str) -> None:
        self._save(self.load() | {source_path: {"type": "custom", "imagePath": image_path}})

    def clear(self, source_path: str) -> None:
        self._save({k: v for k, v in self.load().items() if k != source_path})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, v.get("type", ""), v.get("page"), v.get("imagePath", "")) for k, v in self.load().items()]
        return spark.createDataFrame(rows, OVERRIDE)
