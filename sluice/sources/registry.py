"""The known sources as a dimension, and the protocols that providers and models fulfil."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import SourceUnavailable
from sluice.functions import fixed, urls

#: Sources whose pages can be fetched directly; the others answer "unavailable".
FIRST_TIER = ["linkedin", "indeed", "naukri"]


class SearchProvider(Protocol):
    """Answers fanned-out queries (query_no, query, source_no, source_name) with results or failures as rows."""

    def search(self, asked: DataFrame, most: int) -> DataFrame: ...


class Model(Protocol):
    """Completes a prompt; any exception means it is unreachable."""

    def __call__(self, prompt: str) -> str: ...


def sources(spark: SparkSession) -> DataFrame:
    """(source_no, source_name, domain, scope, tier, base_url, access), the generic source last."""
    hosts = {s: h for h, s in fixed.SOURCE_HOSTS.items()}
    rows = [(i, s, hosts[s], fixed.SOURCE_SCOPES[s], 1 if s in FIRST_TIER else 2, f"https://{hosts[s]}") for i, s in enumerate(fixed.SOURCES)]
    rows.append((len(rows), "generic", None, None, 3, None))
    df = spark.createDataFrame(rows, "source_no int, source_name string, domain string, scope string, tier int, base_url string")
    return df.withColumn("access", F.when(F.col("tier") == 1, "not implemented").otherwise("unavailable"))


def register(name: str, hosts: list[str], external_id: Callable[[Column], Column], canonical: Callable[[Column], Column]) -> None:
    """Add an adapter in front of the generic one."""
    generic = urls.ADAPTERS.pop("generic")
    urls.ADAPTERS[name] = (hosts, external_id, canonical)
    urls.ADAPTERS["generic"] = generic


def fetch_job(source: str) -> None:
    """Direct fetching of a source's pages, which none offers: first-tier sources are not implemented, the others unavailable."""
    if source in FIRST_TIER:
        raise NotImplementedError(f"{source}: no direct access yet")
    raise SourceUnavailable(f"{source}: pages cannot be fetched directly")
