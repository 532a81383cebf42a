"""The operation log as a stream: batch summaries that follow the log as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OP_LOG


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Moves from the JSON lines files of a folder."""
    return spark.readStream.schema(OP_LOG).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def batch_totals(moves: DataFrame) -> DataFrame:
    """Entry and undone counts of each batch, to be written in update or complete mode."""
    return moves.groupBy("batch_id").agg(F.min("timestamp").alias("timestamp"), F.count("*").alias("entry_count"), F.count_if("undone").alias("undone_count"))


def moves_by_hour(moves: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Moves of each hour; the watermark bounds what is remembered."""
    return moves.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", "1 hour")).agg(F.count("*").alias("moves"))
