"""Papers that keep arriving: each micro-batch is appended, and the index is built anew over the table as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import index as ix


def follow(spark: SparkSession, incoming: str, schema: str, target: str, checkpoint: str):
    """Start a query that appends arriving Parquet papers to a table; the checkpoint makes restarts lose and repeat nothing."""
    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(spark: SparkSession, target: str, **build) -> DataFrame:
    """The index over all papers that have arrived."""
    return ix.build(spark.read.parquet(target), **build)
