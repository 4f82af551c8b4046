"""Counting on a stream of reads: counts are sums, so they fold as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.pairs import enumerate_pairs
from ..operators.satc import count_satc


def read_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Reads (sample_id, seq, ...) from Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def stream_counts(reads: DataFrame, anchor_len: int, target_len: int, gap: int = 0) -> DataFrame:
    """The count table of a stream; its state is one row for each (sample, anchor, target)."""
    return count_satc(enumerate_pairs(reads, anchor_len, target_len, gap))


def to_batches(counts: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Hand each update to `step`, for statistics; `once` works off what is there and ends."""
    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (w.trigger(availableNow=True) if once else w).start()
