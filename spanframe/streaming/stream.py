"""Annotation operators on streams: all are stateless maps of single rows, so the batch functions serve unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(path)


def run_stream(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Apply an operator to a stream and append its rows to files, exactly once, until the source is used up."""
    return operator(stream).writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
