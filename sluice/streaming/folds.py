"""The keyed folds over unbounded input: de-duplication, lifecycle, circuit state and health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators import health
from sluice.operators.folds import Breaker
from sluice.operators.history import REMOVAL_THRESHOLD


def first_seen(stream: DataFrame, key: str, at: str, delay: str | None = None) -> DataFrame:
    """The first row of each key; with ``delay`` state is dropped once the watermark has passed."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if delay else stream.dropDuplicates([key])


def lifecycle(stream: DataFrame, key: str, outcome: str, at: str, seq: str, threshold: int = REMOVAL_THRESHOLD) -> DataFrame:
    """(key, lifecycle_status, consecutive_failures) after each batch that touches a key.

    ``outcome`` is success, transient or permanent; rows of a batch are taken in order of (at, seq).
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, failures = state.get if state.exists else ("unknown", 0)
        for _, what in pd.concat(list(frames)).sort_values([at, seq])[[seq, outcome]].itertuples(index=False, name=None):
            if what == "success":
                status, failures = "active", 0
            elif what == "permanent":
                status = "expired"
            else:
                failures += 1
                status = "removed" if failures >= threshold else "unavailable"
        state.update((status, failures))
        yield pd.DataFrame({key: [k[0]], "lifecycle_status": [status], "consecutive_failures": [failures]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, lifecycle_status string, consecutive_failures int", "status string, failures int", "update", GroupStateTimeout.NoTimeout)


def circuits(stream: DataFrame, key: str, ok: str, at: str, seq: str, threshold: int = 5, recovery: float = 60.0) -> DataFrame:
    """(key, circuit_state, failure_count) after each batch that touches a source; ``at`` in seconds."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(threshold, recovery)
        if state.exists:
            b.state, b.failures, b.successes, b.opened_at = state.get
        for now, _, good in pd.concat(list(frames)).sort_values([at, seq])[[at, seq, ok]].itertuples(index=False, name=None):
            b.record(bool(good), float(now))
        state.update((b.state, b.failures, b.successes, b.opened_at))
        yield pd.DataFrame({key: [k[0]], "circuit_state": [b.state], "failure_count": [b.failures]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, circuit_state string, failure_count int", "state string, failures int, successes int, opened_at double", "update", GroupStateTimeout.NoTimeout)


def versions(stream: DataFrame, key: str, digest: str, at: str, seq: str) -> DataFrame:
    """(key, version_number, digest, at) of every row that opens a version: its digest differs from the key's last one. State is that digest and a counter."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        for when, _, value in pd.concat(list(frames)).sort_values([at, seq])[[at, seq, digest]].itertuples(index=False, name=None):
            value = value if isinstance(value, str) else None
            if n == 0 or value != last:
                last, n = value, n + 1
                out.append((k[0], n, value, when))
        state.update((last, n))
        yield pd.DataFrame(out, columns=[key, "version_number", digest, at])

    schema = f"{key} {kinds[key]}, version_number int, {digest} string, {at} {kinds[at]}"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "digest string, n int", "append", GroupStateTimeout.NoTimeout)


def source_health(stream: DataFrame, source: str, statuses: dict[str, Column]) -> DataFrame:
    """The batch aggregate in update mode."""
    return health.source_health(stream, source, statuses)


def windowed_counts(stream: DataFrame, at: str, delay: str, width: str, *keys: str) -> DataFrame:
    """Rows per key and event-time window; rows later than ``delay`` are dropped."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


def _seconds(when: pd.Timestamp) -> float:
    return when.value / 1e9


def cooldown(stream: DataFrame, key: str, at: str, seq: str, succeeded: str, seconds: float, delay: str) -> DataFrame:
    """(key, seq, at, accepted) of every row: whether ``seconds`` have passed since the key's last accepted success.

    ``at`` is a timestamp, with rows up to ``delay`` late. A timer drops the
    state of a key whose cooldown is over, so keys that fall silent cost nothing.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get[0] if state.exists else None), []
        for when, n, good in pd.concat(list(frames)).sort_values([at, seq])[[at, seq, succeeded]].itertuples(index=False, name=None):
            ok = last is None or _seconds(when) - last >= seconds
            if ok and bool(good):
                last = _seconds(when)
            out.append((k[0], n, when, ok))
        until = None if last is None else int((last + seconds) * 1000) + 1
        if until is not None and until > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, seq, at, "accepted"])

    schema = f"{key} {kinds[key]}, {seq} {kinds[seq]}, {at} {kinds[at]}, accepted boolean"
    return stream.withWatermark(at, delay).groupBy(key).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def cache_states(stream: DataFrame, key: str, at: str, ttl_s: float, delay: str) -> DataFrame:
    """(key, state, at): ``live`` when an entry is written that has no live one before it, ``expired`` by a timer when its time is over.

    An entry that is written again before that lives on from then.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moment = lambda s: pd.Timestamp(round(s * 1e6), unit="us")
        if state.hasTimedOut:
            ends = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "state": ["expired"], at: [moment(ends)]})
            return
        ends, out = (state.get[0] if state.exists else None), []
        for when in pd.concat(list(frames))[at].sort_values():
            if ends is not None and _seconds(when) > ends:  # its time was over before its timer came
                out.append((k[0], "expired", moment(ends)))
                ends = None
            if ends is None:
                out.append((k[0], "live", when))
            ends = max(ends or 0.0, _seconds(when) + ttl_s)
        state.update((ends,))
        state.setTimeoutTimestamp(max(int(ends * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "state", at])

    return stream.withWatermark(at, delay).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, state string, {at} {kinds[at]}", "ends double", "append", GroupStateTimeout.EventTimeTimeout)
