"""A training-data pipeline over ``documents``: filter, de-duplicate, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard_join, line_dedup, packing, scratch, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their own labelled rows, does not call toxic; all of them if those rows teach nothing."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs.select(*COLUMNS)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; those that lose their last words go."""
    out = line_dedup.remove_repeated_lines(docs.select(*COLUMNS))
    empty = (F.col("n_deleted") > 0) & ~F.col("text").rlike(line_dedup.WORDS)
    n_chars = F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~empty).withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without id stay, and rows that repeat the smallest id."""
    return jaccard_join.representatives(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and a tokenizer decide rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage leaves besides its result goes, and so does its input."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch.only() as spared:
            out = scratch.keep(stage(spark, docs, sf_dir), name)
            spared.append(out)
        scratch.drop(docs)
        docs = out
        scratch.release(spark)
    return docs
