"""An extension: merging observation files as they arrive.

The merge is idempotent by (position, alleles, provenance), so a stream of files can drop
repeats with bounded state and append what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.merge import allele_key


def stream_observations(spark: SparkSession, path: str, schema, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """New observations under ``path``; with an event time the state of repeats is bounded by it."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("allele_key", allele_key(F.col("all_alleles")))
    keys = ["position", "allele_key", "provenance"]
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys).drop("allele_key")
    return rows.dropDuplicates(keys).drop("allele_key")


def write_merged(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_depth(stream: DataFrame, event_time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Observations per position and time window, late ones within ``delay`` counted."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "position").agg(F.count("*").alias("depth"))
