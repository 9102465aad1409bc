"""Raw pages by slot (source, job_key): one row holds what a slot's four files hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import content_hash, job_key, safe_name

COLUMNS = ["source", "job_key", "raw_html", "raw_text", "metadata", "retrieval"]


def slots(pages: DataFrame, source: str, html: str) -> DataFrame:
    """``pages`` with content_hash and the safe slot names source and job_key."""
    digest = content_hash(F.col(html).cast("string"))
    return pages.withColumn("content_hash", digest).withColumn("job_key", safe_name(job_key(F.col("content_hash")))).withColumn("source", safe_name(F.col(source)))


def _stored(spark: SparkSession, root: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in [*COLUMNS, "_batch"])
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def save(rows: DataFrame, root: str, batch: str | None = None) -> None:
    """Write the slots that no other batch has, once each, partitioned by batch and source; missing columns are null.

    A slot's name is the hash of its page, so what is stored already is the
    same page: only the names of stored slots are read, never their contents.
    A batch that is written again takes its own place.
    """
    spark, batch = rows.sparkSession, batch or uuid.uuid4().hex
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    keys = ["source", "job_key"]
    one = rows.select(*have).groupBy(*keys).agg(F.min(F.struct("metadata", "retrieval", "raw_html", "raw_text")).alias("s")).select(*keys, "s.*")
    others = _stored(spark, root).where(F.col("_batch") != batch).select(*keys)
    one.join(others, keys, "left_anti").select(*COLUMNS).write.mode("overwrite").partitionBy("source").parquet(f"{root}/_batch={batch}")


def load(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Slots of ``wanted`` (source, job_key), null where there is none; partitions are pruned by source."""
    return wanted.join(_stored(spark, root).drop("_batch"), ["source", "job_key"], "left")


def existing(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    return wanted.join(_stored(spark, root).select("source", "job_key"), ["source", "job_key"], "left_semi")


def _one(spark: SparkSession, root: str, wanted: DataFrame, column: str) -> DataFrame:
    return load(spark, root, wanted.select("source", "job_key")).select("source", "job_key", column)


def load_html(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(source, job_key, raw_html), null where a slot is missing; only that column is read."""
    return _one(spark, root, wanted, "raw_html")


def load_text(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(source, job_key, raw_text), null where a slot is missing."""
    return _one(spark, root, wanted, "raw_text")


def load_metadata(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(source, job_key, metadata) as a map, null where a slot is missing."""
    return _one(spark, root, wanted, "metadata").withColumn("metadata", F.from_json("metadata", "map<string,string>"))


def load_retrieval(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(source, job_key, retrieval) as a map, null where a slot is missing."""
    return _one(spark, root, wanted, "retrieval").withColumn("retrieval", F.from_json("retrieval", "map<string,string>"))
