"""Splits that arrive over time: a folder that is read with Structured Streaming.

The engine's own tables are finite. Where files keep arriving, a stream over their folder
takes each file once, and a mergeable aggregate keeps its state in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators import relational as ops


def read_arriving(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def aggregate_arriving(stream: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    """A running aggregate over a stream."""
    return ops.aggregate(stream, keys, aggregates)


def drain(result: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "complete") -> StreamingQuery:
    """Runs over all files that are there, calls each(batch, number), and stops."""
    query = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query
