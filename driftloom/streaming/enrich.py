"""Features over streams: the same stateless select as in a batch, so a stream gives the rows a batch would.

Event-time windows go beyond plain enrichment and are kept apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftloom.operators.features import Feature, enrich


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; ``files_at_once`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    for name, value in (("maxFilesPerTrigger", files_at_once), ("pathGlobFilter", pattern)):
        reader = reader.option(name, value) if value is not None else reader
    return reader.parquet(path)


def enrich_stream(stream: DataFrame, features: Sequence[Feature], keep: Sequence[str] = (), defaults: bool = False) -> DataFrame:
    """Expression features only: a stream has no other rows to ask."""
    if any(f.query for f in features):
        raise ValueError("SQL features need the whole table")
    return enrich(stream, features, keep=keep, defaults=defaults)


def write_all(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is to a folder and ends; a later call goes on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the whole result of an aggregated stream, open windows too, over the folder's content and ends; a later call
    goes on from there. Groups are kept for good, so that no row is too late.
    """
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window of event time. ``write_latest`` counts all of them; ``write_all`` writes closed windows only, and rows
    later than ``late`` are no longer counted there.
    """
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), by).agg(F.count("*").alias("n"))
