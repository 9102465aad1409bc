"""Search providers: what answers the fanned-out queries of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.errors import SearchError
from sluice.sources import remote, search_pages

Provider = Callable[[DataFrame, int], DataFrame]
ANSWER = "classification string, title string, url string, snippet string, rank int"


def nothing(asked: DataFrame, most: int) -> DataFrame:
    """No results, for runs without a search engine."""
    return asked.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in ANSWER.split(", "))]).where(F.lit(False))


def result_pages(get: Callable[[str], tuple[int, bytes]], attempts: int = 1) -> Provider:
    """Asks an engine's result pages by scoped URL: one row per result, and one row with the class alone for a query that failed."""

    def search(asked: DataFrame, most: int) -> DataFrame:
        got = remote.fetch(asked, "scoped_url", get, remote.Manners(attempts=attempts)).withColumn("page", F.decode("body", "UTF-8"))
        got = got.withColumn("classification", search_pages.classify(F.col("http_status"), F.col("page"), F.col("error")))
        found = got.withColumn("found", F.when(F.col("classification") == "SEARCH_SUCCESS", search_pages.results(F.col("page"), most)))
        return found.select(*asked.columns, "classification", F.posexplode_outer("found").alias("pos", "r")).select(*asked.columns, "classification", "r.title", "r.url", "r.snippet", (F.col("pos") + 1).alias("rank"))

    return search


def provider(engine: str, get: Callable[[str], tuple[int, bytes]] | None = None) -> Provider:
    """The provider of an engine: 'mock', or any engine without a transport, finds nothing; 'pages' reads result pages."""
    if engine == "mock" or get is None:
        return nothing
    if engine == "pages":
        return result_pages(get)
    raise SearchError(f"no search engine {engine!r}")
