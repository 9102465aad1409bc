"""The registered query of each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import oracle, scratch, token_codes
from sluice.llm.decontaminate import contamination
from sluice.llm.html_text import extract
from sluice.llm.importance import resample
from sluice.llm.jaccard_join import jaccard_components
from sluice.llm.line_dedup import remove_repeated_lines
from sluice.llm.packing import pack
from sluice.llm.quality_rules import quality
from sluice.llm.spelling import variants
from sluice.llm.suffix_dedup import remove_repeats
from sluice.llm.tool_calls import REPLY, as_calls, format_messages
from sluice.llm.toxicity import toxicity
from sluice.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_messages(as_calls(table(spark, sf_dir, "conversations")), REPLY)
    return out.select("conv_id", F.col("position").alias("turn"), "kind", "call_id", "linked", "level", "ordinal", "valid", F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.round_trip(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def alone(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` in a scope of its own: of what it writes, only what its result reads is left, and nothing if it fails."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch.only() as spared:
            out = query(spark, sf_dir)
            spared.append(out)
        return out

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: alone(f) for f in (op1_quality_rules, op2_suffix_dedup, op3_toxicity, op4_jaccard_join, op5_warc, op6_line_dedup, op7_chat_format, op8_html_text, op9_packing, op10_decontaminate, op11_spelling, op12_token_codes, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
