"""Duplicate detection, and destination paths made distinct.

Detection needs no self-join.  Rows are first combined to distinct sizes by (key, format), so a key that many rows share is
small before it is sorted; as the allowance grows slower than the size, the nearest size decides whether any is close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text

NOT, POSSIBLE, LIKELY = "NotDuplicate", "PossibleDuplicate", "LikelyDuplicate"


def duplicates(books: DataFrame) -> DataFrame:
    """books: title and author as strings, format, size_bytes.  Adds duplicate_group_id and duplicate_status.

    Rows of one normalised title and author are a group if there are two or more; rows with neither never are.  A member
    is likely if another one of its format is close in size.  A group's id is a hash of its key."""
    key = F.concat(text.duplicate_key(F.col("title")), F.lit("|"), text.duplicate_key(F.col("author")))
    keyed = books.withColumn("_key", key)
    sizes = keyed.where("_key <> '|'").groupBy("_key", "format", "size_bytes").agg(F.count("*").alias("n"))
    near = Window.partitionBy("_key", "format").orderBy("size_bytes")
    close = lambda other: F.coalesce(text.sizes_close(F.col("size_bytes"), other), F.lit(False))
    sizes = sizes.withColumns({"_before": F.lag("size_bytes").over(near), "_after": F.lead("size_bytes").over(near), "_all": F.sum("n").over(Window.partitionBy("_key"))})
    likely = (F.col("n") > 1) | close(F.col("_before")) | close(F.col("_after"))
    sizes = sizes.where("_all > 1").select(F.col("_key").alias("_k"), F.col("format").alias("_f"), F.col("size_bytes").alias("_s"), F.when(likely, LIKELY).otherwise(POSSIBLE).alias("_status"))
    same = (F.col("_key") == F.col("_k")) & F.col("format").eqNullSafe(F.col("_f")) & F.col("size_bytes").eqNullSafe(F.col("_s"))
    # rows without title and author are in no group: each goes its own way instead of meeting under one key
    blank = F.coalesce(F.col("_key") == "|", F.lit(True))
    plain = [F.col(f"`{f.name}`") for f in books.schema if not isinstance(f.dataType, T.MapType)]
    out = keyed.withColumn("_key", F.when(blank, F.concat(F.lit("||"), F.xxhash64(*plain).cast("string"))).otherwise(F.col("_key")))
    out = out.join(sizes, same, "left")
    group = F.when(F.col("_status").isNotNull(), F.concat(F.lit("dup-"), F.substring(F.sha2("_key", 256), 1, 12))).otherwise("")
    return out.withColumns({"duplicate_group_id": group, "duplicate_status": F.coalesce("_status", F.lit(NOT))}).drop("_key", "_k", "_f", "_s", "_status")


def distinct_destinations(books: DataFrame, order: str = "scan_ord") -> DataFrame:
    """The n-th row with a destination path, in scan order, gets ' (n)' before the extension; empty paths stay."""
    # rows without a path do not meet
    empty = F.coalesce(F.col("dest_path") == "", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("dest_path", F.when(empty, F.col(order))).orderBy(order))
    out = books.withColumn("_n", nth)
    return out.withColumn("dest_path", F.when(empty, F.col("dest_path")).otherwise(paths.numbered(F.col("dest_path"), F.col("_n")))).drop("_n")
