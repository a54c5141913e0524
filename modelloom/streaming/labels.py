"""The label log as a stream: the last record of each entity, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only folder of Parquet files as a stream. Local timestamps become timestamps, as watermarks need."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, replaced as later records come (update or complete mode). State: one record a key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def windowed_drift(log: DataFrame, time: str, label: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of labels in windows of the log's time; a window is final once the watermark has passed it."""
    return log.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
