"""Order-dependent folds: rows of a key in sequence through a small state.

Rows are dealt by key and sorted inside the partition; the fold keeps one state
at a time, so a key of any length needs no more memory than a short one.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], outputs: str, names: list[str]) -> DataFrame:
    """``df`` with the ``names`` that ``step(state, row)`` returns for each row, in ``order`` within ``key``."""
    columns = df.columns
    at = columns.index(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if row[at] != now:
                    now, state = row[at], start()
                out.append(step(state, row))
            yield pd.concat([pdf, pd.DataFrame(out, columns=names, index=pdf.index)], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + outputs
    return df.where(df[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


@dataclasses.dataclass
class Breaker:
    """Circuit of one source."""

    threshold: int = 5
    recovery: float = 60.0
    needed: int = 1
    state: str = CLOSED
    failures: int = 0
    successes: int = 0
    opened_at: float = 0.0
    begun: bool = False

    def look(self, now: float) -> str:
        """State when asked: an open circuit turns half open once the recovery time is over."""
        if self.state == OPEN and now - self.opened_at >= self.recovery:
            self.state, self.successes = HALF_OPEN, 0
        return self.state

    def record(self, ok: bool, now: float) -> None:
        self.look(now)
        if ok:
            if self.state == HALF_OPEN:
                self.successes += 1
                if self.successes >= self.needed:
                    self.state, self.failures = CLOSED, 0
            elif self.state == CLOSED:
                self.failures = 0
            return
        if self.state != HALF_OPEN:  # a failed probe opens the circuit again without counting
            self.failures += 1
        if self.state == HALF_OPEN or self.failures >= self.threshold:
            self.state, self.opened_at = OPEN, now


def circuit_states(df: DataFrame, key: str, at: str, ok: str, *order: str, threshold: int = 5, recovery: float = 60.0) -> DataFrame:
    """``df`` with circuit_state and failure_count after each outcome (``at`` in seconds, ``ok`` boolean)."""
    t, o = df.columns.index(at), df.columns.index(ok)

    def step(b: Breaker, row: tuple) -> tuple:
        b.record(bool(row[o]), float(row[t]))
        return b.state, b.failures

    return ordered_fold(df, key, [at, *order], lambda: Breaker(threshold, recovery), step, "circuit_state string, failure_count int", ["circuit_state", "failure_count"])


def circuits_from(df: DataFrame, key: str, at: str, ok: str, stored: DataFrame, *order: str, threshold: int = 5, recovery: float = 60.0) -> DataFrame:
    """``circuit_states`` that go on from ``stored`` (key, circuit_state, consecutive_failures, opened_at in seconds); adds opened_at too."""
    known = stored.select(key, F.col("circuit_state").alias("_state"), F.col("consecutive_failures").alias("_failures"), F.col("opened_at").alias("_opened"))
    # one row per source; after a join that shuffles by key, Spark drops the fold's own dealing and may then read the join's rows undealt
    both = df.join(F.broadcast(known), key, "left")
    t, o, s, n, w = (both.columns.index(c) for c in (at, ok, "_state", "_failures", "_opened"))

    def step(b: Breaker, row: tuple) -> tuple:
        if not b.begun:
            b.begun = True
            if isinstance(row[s], str):
                b.state, b.failures, b.opened_at = row[s], int(row[n] or 0), float(row[w] if row[w] == row[w] and row[w] is not None else 0.0)
        b.record(bool(row[o]), float(row[t]))
        return b.state, b.failures, b.opened_at

    names = ["circuit_state", "failure_count", "opened_at"]
    return ordered_fold(both, key, [at, *order], lambda: Breaker(threshold, recovery), step, "circuit_state string, failure_count int, opened_at double", names).drop("_state", "_failures", "_opened")


#: Of outcomes in order: how many, how many failed, failures before the first success and after the last one
#: (all, if there is none), and the failures up to the one after the first success that opens a closed circuit (-1: none).
SUMMARY = ["n", "bad", "lead", "trail", "inside"]


def summary(ok: np.ndarray, threshold: int) -> tuple[int, ...]:
    n, good = len(ok), np.flatnonzero(ok)
    if not len(good):
        return n, n, n, n, -1
    after = np.diff(np.append(good, n)) - 1  # failures that follow each success
    long = np.flatnonzero(after >= threshold)
    inside = int(good[long[0]] - long[0]) + threshold if len(long) else -1
    return n, n - len(good), int(good[0]), int(after[-1]), inside


def joined(a: tuple[int, ...], b: tuple[int, ...], threshold: int) -> tuple[int, ...]:
    """Summary of the outcomes of ``a`` and then those of ``b``."""
    (n, bad, lead, trail, inside), (n2, bad2, lead2, trail2, inside2) = a, b
    if inside < 0:
        if bad < n and trail + lead2 >= threshold:
            inside = bad - trail + threshold
        elif inside2 >= 0:
            inside = bad + inside2
    return n + n2, bad + bad2, lead if bad < n else lead + lead2, trail2 if bad2 < n2 else trail + trail2, inside


def circuit_after(state: str, failures: int, opened_at: float, s: tuple[int, ...], now: float, threshold: int, recovery: float) -> tuple[str, int, float]:
    """State, failures and opening time after outcomes at one time ``now``: what ``Breaker`` (one probe needed) records one by one."""
    n, bad, lead, trail, inside = s
    if state == OPEN and now - opened_at >= recovery:
        state = HALF_OPEN
    if state == HALF_OPEN:
        if lead:  # the probe failed, which does not count
            return OPEN, failures + bad - 1, now
        state, failures = CLOSED, 0
    if state == OPEN:
        return OPEN, failures + bad, now if bad and failures + bad >= threshold else opened_at
    if lead and failures + lead >= threshold:
        return OPEN, failures + bad, now
    if inside >= 0:
        return OPEN, threshold + bad - inside, now
    return CLOSED, trail if bad < n else failures + bad, opened_at


def circuits_after(df: DataFrame, key: str, at: Column, ok: str, stored: DataFrame, *order: str, threshold: int = 5, recovery: float = 60.0) -> DataFrame:
    """(key, circuit_state, failure_count, opened_at, n, bad) after all outcomes of ``df``, which are of one time ``at`` (seconds).

    The last row of each key in ``circuits_from``, and how many outcomes it has and how many
    failed. Rows are dealt by range of (key, order): a key with very many
    outcomes lies in many partitions, each sums up its part, and one row per
    key and partition is folded.
    """
    if recovery <= 0:
        raise ValueError("recovery must be positive: a circuit that opens now stays open")
    kind, sums = dict(df.dtypes)[key], ", ".join(f"{c} bigint" for c in SUMMARY)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, held = TaskContext.get().partitionId(), None, None
        for pdf in frames:
            if not len(pdf):
                continue
            keys, good, out = pdf[key].to_numpy(object), pdf[ok].to_numpy(bool), []
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                s = summary(good[i:j], threshold)
                if held is not None and keys[i] == now:
                    held = joined(held, s, threshold)
                    continue
                if held is not None:
                    out.append((now, part, *held))
                now, held = keys[i], s
            yield pd.DataFrame(out, columns=[key, "_part", *SUMMARY])
        if held is not None:
            yield pd.DataFrame([(now, part, *held)], columns=[key, "_part", *SUMMARY])

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("_part")[[*SUMMARY]].itertuples(index=False, name=None))
        s = rows[0]
        for more in rows[1:]:
            s = joined(s, more, threshold)
        first = pdf.iloc[0]
        state, failures, opened = (first["_state"], int(first["_failures"]), float(first["_opened"])) if isinstance(first["_state"], str) else (CLOSED, 0, 0.0)
        return pd.DataFrame([(first[key], *circuit_after(state, failures, opened, s, float(first["_now"]), threshold, recovery), s[0], s[1])], columns=[key, "circuit_state", "failure_count", "opened_at", "n", "bad"])

    parts = df.where(F.col(key).isNotNull()).select(key, ok, *order).repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInPandas(summed, f"`{key}` {kind}, _part int, {sums}")
    known = stored.select(key, F.col("circuit_state").alias("_state"), F.coalesce("consecutive_failures", F.lit(0)).alias("_failures"), F.coalesce("opened_at", F.lit(0.0)).alias("_opened"))
    both = parts.join(known, key, "left").withColumn("_failures", F.coalesce("_failures", F.lit(0))).withColumn("_opened", F.coalesce("_opened", F.lit(0.0))).withColumn("_now", at)
    return both.groupBy(key).applyInPandas(last, f"`{key}` {kind}, circuit_state string, failure_count int, opened_at double, n bigint, bad bigint")


def cooldown(df: DataFrame, key: str, at: str, succeeded: str, seconds: float, *order: str) -> DataFrame:
    """``df`` with accepted: never run before, or at least ``seconds`` since the last successful accepted run."""
    t, o = df.columns.index(at), df.columns.index(succeeded)

    def step(state: dict, row: tuple) -> tuple:
        last, now = state.get("last"), float(row[t])
        ok = last is None or now - last >= seconds
        if ok and bool(row[o]):
            state["last"] = now
        return (ok,)

    return ordered_fold(df, key, [at, *order], dict, step, "accepted boolean", ["accepted"])
