"""Keyed folds as streams over ``events``, with the SQL of the batch folds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans import catalogue
from sluice.sources import shared
from sluice.streaming import folds


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream, taken in as it lies there."""
    schema = catalogue.table(spark, d, "events").schema
    # a stream reads a folder or a pattern, and the table may be one file
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """All rows of a stream over what is there now, by way of files in the shared folder; an epoch that is repeated replaces itself."""
    spark, folder = stream.sparkSession, f"{shared.base(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@catalogue.query(catalogue.SQL["cooldown_accept"])
def cooldown_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "at", (F.col("event_type") != "error").alias("ok"))
    return drained(folds.cooldown(e, "user_id", "at", "event_id", "ok", 43200, "365 days")).select("user_id", "event_id", "accepted")


@catalogue.query(f"WITH {catalogue._VERSIONS} SELECT user_id, version_number, event_type, epoch_us(ts) AS at_us FROM v WHERE fresh = 1")
def version_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "at", "event_type")
    return drained(folds.versions(e, "user_id", "event_type", "at", "event_id")).select("user_id", "version_number", "event_type", F.unix_micros("at").alias("at_us"))
