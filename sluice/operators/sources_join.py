"""Sources of URLs from a table of domains: a host belongs to the longest of its own suffixes that is registered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import urls


def suffixes(host: Column) -> Column:
    """A host and what is left of it when its labels are taken away from the front, one by one."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def source_by_host(df: DataFrame, url: str, domains: DataFrame, default: str = "generic") -> DataFrame:
    """``df`` with source_name from ``domains`` (domain, source_name), ``default`` where no suffix of the host is a domain.

    Suffixes meet domains by equality, each distinct host once, so neither a
    host with very many pages nor a long table of domains costs more than a
    join. A domain that is listed twice gives its first source; null and
    hostless URLs get the default. Port and case of the host do not count.
    """
    host = F.regexp_replace(F.lower(urls.part(F.col(url), 2)), r"^.*@|:\d*$", "")
    keyed = df.drop("source_name").withColumn("_host", host)
    listed = domains.select(F.lower("domain").alias("_suffix"), F.col("source_name")).groupBy("_suffix").agg(F.min("source_name").alias("source_name"))
    each = keyed.select("_host").where("length(_host) > 0").distinct().select("_host", F.explode(suffixes(F.col("_host"))).alias("_suffix"))
    found = each.join(listed, "_suffix").groupBy("_host").agg(F.max_by("source_name", F.length("_suffix")).alias("source_name"))
    return keyed.join(found, "_host", "left").drop("_host").withColumn("source_name", F.coalesce("source_name", F.lit(default)))
