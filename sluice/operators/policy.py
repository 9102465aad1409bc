"""Fetch policy over a stream of candidates: circuit, robots, budget."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import fixed, urls


def origin(url: Column) -> Column:
    """Scheme and host of a URL in lower case."""
    return F.concat(F.lower(urls.part(url, 1)), F.lit("://"), F.lower(urls.part(url, 2)))


def path_allowed(url: Column, rules: Column, agent: str) -> Column:
    """Whether a robots.txt (its text; null allows all) lets ``agent`` fetch the URL's path."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, RobotFileParser] = {}
        for u, r in batches:
            out = []
            for one, text in zip(u, r, strict=True):
                if not isinstance(text, str) or not isinstance(one, str):
                    out.append(True)
                    continue
                if text not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[text] = RobotFileParser()
                    known[text].parse(text.splitlines())
                out.append(known[text].can_fetch(agent, one))
            yield pd.Series(out, dtype=bool)

    return run(url, rules)


def robots_by_path(df: DataFrame, url: str, texts: DataFrame, agent: str = "*") -> DataFrame:
    """``df`` with robots_allowed from ``texts`` (origin, robots_text), path by path; an unknown or unread origin is allowed."""
    known = texts.select(F.col("origin").alias("_origin"), F.col("robots_text").alias("_text"))
    return df.join(known, origin(F.col(url)) == F.col("_origin"), "left").withColumn("robots_allowed", path_allowed(F.col(url), F.col("_text"), agent)).drop("_origin", "_text")


def reason(decision: Column, source: Column, url: Column, budget: int) -> Column:
    """Why a URL is not fetched; empty where it is."""
    return (
        F.when(decision == "block_circuit_open", F.concat(F.lit("Circuit open for source="), source)).when(decision == "block_robots", F.concat(F.lit("robots.txt disallows "), url))
        .when(decision == "block_budget", F.lit(f"Fetch budget exhausted ({budget} fetches)")).otherwise("")
    )


def robots(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """``df`` with robots_allowed from ``rules`` (origin, allowed); an unknown origin is allowed."""
    known = rules.select(F.col("origin").alias("_origin"), F.col("allowed").alias("_allowed"))
    return df.join(known, origin(F.col(url)) == F.col("_origin"), "left").withColumn("robots_allowed", F.coalesce("_allowed", F.lit(True))).drop("_origin", "_allowed")


def decide(df: DataFrame, run: str, circuit_open: Column, allowed: Column, succeeded: Column, budget: int, *order: str) -> DataFrame:
    """``df`` with decision: the first of block_circuit_open, block_robots, block_budget that holds, else allow.

    The budget counts successful fetches before the row, per run; 0 is unlimited.
    """
    passes = ~circuit_open & allowed
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a row beyond the budget is not fetched, so successes before it are at most the budget
    used = F.coalesce(F.sum((passes & succeeded).cast("int")).over(before), F.lit(0))
    spent = F.lit(budget > 0) & (used >= budget)
    return df.withColumn("decision", F.when(circuit_open, "block_circuit_open").when(~allowed, "block_robots").when(spent, "block_budget").otherwise("allow"))


def status_class(code: Column) -> Column:
    return F.when(code.isin(fixed.RETRYABLE), "retryable").when(code.isin(fixed.PERMANENT), "permanent").otherwise("success")
