"""Queries of the operation log.

A log is a table of moves in the order of log_ord.  Undoing appends an event instead of rewriting the log; the current
state of a move is its latest event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MOVE = ("batch_id", "old_path", "new_path")


def folded(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with undone as the latest event says.  events: log_ord, batch_id, undone, and old_path and new_path, both null
    for an event on a whole batch.  Events on moves that the log does not have say nothing."""
    of_move = events.where("old_path is not null").groupBy(*MOVE).agg(F.max(F.struct("log_ord", "undone")).alias("_m"))
    of_batch = events.where("old_path is null").groupBy("batch_id").agg(F.max(F.struct("log_ord", "undone")).alias("_b"))
    out = log.join(of_move, list(MOVE), "left").join(of_batch, "batch_id", "left")
    # whichever came later; a missing one sorts first
    last = F.greatest(F.col("_m"), F.col("_b"))
    return out.withColumn("undone", F.coalesce(last["undone"], F.col("undone"))).select(*log.columns)


def batches(log: DataFrame) -> DataFrame:
    """batch_id, timestamp (of its first entry), entry_count, undone_count, first_ord."""
    return log.groupBy("batch_id").agg(
        F.min_by("timestamp", "log_ord").alias("timestamp"), F.count("*").alias("entry_count"), F.count_if("undone").alias("undone_count"), F.min("log_ord").alias("first_ord")
    )


def remaining(summaries: DataFrame) -> DataFrame:
    """Adds remaining_count: what can still be undone."""
    return summaries.withColumn("remaining_count", F.col("entry_count") - F.col("undone_count"))


def batch_views(log: DataFrame) -> DataFrame:
    """Batches with their entries nested in log order; newest_rank 1 is the batch that appeared last.  One shuffle."""
    entry = F.struct("log_ord", "op_type", "old_path", "new_path", "undone")
    out = log.groupBy("batch_id").agg(
        F.min_by("timestamp", "log_ord").alias("timestamp"), F.count("*").alias("entry_count"), F.count_if("undone").alias("undone_count"),
        F.min("log_ord").alias("first_ord"), F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    return out.withColumn("timestamp_text", text.rfc3339(F.col("timestamp"))).orderBy(F.col("first_ord").desc())


def batch_rows(log: DataFrame) -> DataFrame:
    """The entries of batches one by one, each with its batch's summary, for batches that are too long for one row."""
    return log.join(batches(log).withColumnRenamed("timestamp", "batch_timestamp"), "batch_id")


def next_batch_id(log: DataFrame, today: str) -> DataFrame:
    """One row, next_batch_id: today's prefix (yyyyMMdd) with one more than the largest number used."""
    rest = F.when(F.startswith("batch_id", F.lit(today + "-")), F.substr("batch_id", F.lit(len(today) + 2)))
    number = F.when(rest.rlike(r"^[+-]?[0-9]+\z"), F.expr("try_cast(substr(batch_id, %d) as bigint)" % (len(today) + 2)))
    return log.agg(F.concat(F.lit(today + "-"), (F.greatest(F.coalesce(F.max(number), F.lit(0)), F.lit(0)) + 1).cast("string")).alias("next_batch_id"))


def to_undo(log: DataFrame, batch_id: str) -> DataFrame:
    """The moves of a batch that stand, newest first."""
    return log.where((F.col("batch_id") == batch_id) & ~F.col("undone")).orderBy(F.col("log_ord").desc())


def to_redo(log: DataFrame, batch_id: str) -> DataFrame:
    return log.where((F.col("batch_id") == batch_id) & F.col("undone")).orderBy("log_ord")


def newest_first(entries: DataFrame, order: Column | str = "log_ord") -> DataFrame:
    """The reverse of the order in which entries were appended."""
    return entries.orderBy((F.col(order) if isinstance(order, str) else order).desc())


def warning_views(warnings: DataFrame) -> DataFrame:
    return newest_first(warnings).withColumn("timestamp_text", text.rfc3339(F.col("timestamp")))
