"""Helpers that the operators of this subpackage share.

Words are ``[^\\x20\\x09-\\x0D]+``.  ``bytes.split()`` with no argument splits on exactly those six
ASCII characters, so the operators that run Python read texts as UTF-8 bytes.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
#: Most words that a Python worker remembers the hash of (about 200 bytes each).
CACHED_WORDS = 200_000
#: Most bytes of a side that is broadcast, as estimated from its rows; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20

#: Whether Spark removes the shuffle files of a query when it has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a temporary one if all of Spark is in this process (master
    local), as in tests; on a cluster executors would not see it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        atexit.register(shutil.rmtree, _FALLBACK[app].removeprefix("file://"), ignore_errors=True)
    return _FALLBACK[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there, and the
    loss of an executor costs nothing that was written.  The files that it was shuffled through go at once, so the disk holds
    those of one table at a time.  discard() removes what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelf_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what written() wrote for these frames.  For tables that only other written tables were made from: a result that
    is still to be computed must not read them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shelf_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(name: str = "text"):
    """The column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def _weight(column, kind):
    """About the bytes of a value, as a Column."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StructType | T.StringType | T.BinaryType | T.ArrayType):
            return F.coalesce(F.aggregate(column, F.lit(16).cast("long"), lambda n, x: n + _weight(x, inner)), F.lit(16))
        return 16 + 8 * F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_weight(column[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most about ``most`` bytes, which are summed first; as it is, and so
    shuffled, otherwise.  df should be cheap to read twice: a written table."""
    row = sum((_weight(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(24)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


class WordHash(dict):
    """64-bit hash of a word given as bytes; remembers at most CACHED_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the high and low bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh3_64_intdigest(f"position {i}".encode()) | 1) for i in range(n)]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive values; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i, c in enumerate(odd_constants(n)):
        out += hashes[i : i + len(out)] * c
    return mixed(out)


def slices(batches: Iterable, rows: int = 256) -> Iterable:
    """Parts of Arrow batches, for work whose results are much larger than its texts.  Memory that Arrow no longer uses
    is given back, as a worker goes on to other tasks."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def string_rows(column) -> Iterable[bytes]:
    """The values of an Arrow binary column, null as empty."""
    return (x or b"" for x in column.to_pylist())
