"""Run records from run events, failure logs, and the last circuit state of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.history import latest

#: Event to the status it puts a run in.
STATUS = {"created": "pending", "started": "running", "completed": "completed", "partial": "partial", "failed": "failed"}
RESUMABLE = ["running", "partial"]


def run_records(events: DataFrame, run: str, event: str, at: str, reason: str, query: str, *order: str) -> DataFrame:
    """(run, status, started_at, completed_at, execution_duration_s, queries_issued, errors) folded from events.

    The last status event decides the status; a run is over when one of completed, partial or failed is last.
    Reasons and issued queries are kept in order of the events.
    """
    seq = F.struct(at, *order)
    mapping = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    status = F.try_element_at(mapping, F.col(event))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(seq.alias("seq"), x.alias("value"))))), lambda v: v["value"])
    out = events.groupBy(run).agg(
        F.max_by(status, F.when(status.isNotNull(), seq)).alias("status"), F.min(F.when(F.col(event) == "started", F.col(at))).alias("started_at"),
        F.max(F.when(F.col(event).isin("completed", "partial", "failed"), F.col(at))).alias("_over"), listed(F.col(query)).alias("queries_issued"), listed(F.col(reason)).alias("errors"),
    )
    over = F.when(F.col("status").isin("completed", "partial", "failed"), F.col("_over"))
    return out.withColumn("completed_at", over).drop("_over").withColumn("execution_duration_s", (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1e6))


def resumable(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(RESUMABLE))


def failure_log(responses: DataFrame, classification: str) -> DataFrame:
    """The responses that failed, for the log; successes with zero results are no failures."""
    return responses.where(~F.col(classification).startswith("SEARCH_SUCCESS"))


def open_sources(states: DataFrame, source: str, state: str, *order: str) -> DataFrame:
    """Sources whose last circuit state is open."""
    return latest(states, source, *order).where(F.col(state) == "open").select(source)
