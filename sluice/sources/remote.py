"""Calls to the outside from inside partitions: page fetches with retries, and model interpretation with re-prompts.

The transport and the model are injected callables, so nothing here opens a
connection by itself. Outcomes are columns, never exceptions.
"""

from __future__ import annotations

import dataclasses
import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import answers, fixed
from sluice.operators.policy import origin

ATTEMPTS, BASE_SECONDS, MOST_SECONDS = 3, 2.0, 30.0
FETCHED = "http_status int, body binary, error string, retry_count int, result string"


def backoff(attempt: int, base: float = BASE_SECONDS, most: float = MOST_SECONDS, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait before the next attempt: doubling from ``base`` up to ``most``, plus up to one second."""
    return min(most, base * 2 ** (attempt - 1)) + jitter()


def http_get(timeout_s: float, most_bytes: int = 10 << 20) -> Callable[[str], tuple[int, bytes]]:
    """A transport over the standard library that gives up after ``timeout_s``; a page beyond ``most_bytes`` is an error."""

    def get(url: str) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(url, timeout=timeout_s) as r:
                body = r.read(most_bytes + 1)
                status = r.status
        except urllib.error.HTTPError as e:
            return e.code, b""
        if len(body) > most_bytes:
            raise OSError(f"more than {most_bytes} bytes")
        return status, body

    return get


def fetch_one(url: str, get: Callable[[str], tuple[int, bytes]], attempts: int = ATTEMPTS, base: float = BASE_SECONDS, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(status, body, error, retries, result): transient failures are tried again, permanent ones are not."""
    status, body, error = None, None, None
    for k in range(attempts):
        try:
            status, body = get(url)
            error = None
        except Exception as e:  # any transport failure is a transient outcome
            status, body, error = None, None, str(e)
        if error is None and status not in fixed.RETRYABLE:
            return status, body, None, k, "permanent_failure" if status in fixed.PERMANENT else "success"
        if k + 1 < attempts:
            sleep(backoff(k + 1, base))
    return status, body, error, attempts - 1, "transient_failure"


class Pace:
    """Waits so that the calls of one queue begin at least ``seconds`` apart."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.next = seconds, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = max(self.clock(), self.next)
        self.next = now + self.seconds


@dataclasses.dataclass(frozen=True)
class Manners:
    """How pages are asked for: attempts and their back-off, seconds between two calls to a host, hosts asked at once by a task, and connections to one host."""

    attempts: int = ATTEMPTS
    backoff_s: float = BASE_SECONDS
    pace_s: float = 0.0
    at_once: int = 8
    per_host: int = 1


def fetch(urls: DataFrame, url: str, get: Callable[[str], tuple[int, bytes]], manners: Manners = Manners()) -> DataFrame:  # noqa: B008
    """``urls`` with the outcome of fetching each.

    Rows are dealt by host, so that hosts are asked in parallel by tasks and by
    the threads of a task, and the calls to one host follow one another at their
    pace. ``per_host`` connections deal a host with very many pages over as many
    queues, which share its pace.
    """
    key = F.concat_ws("#", origin(F.col(url)), F.pmod(F.xxhash64(url), F.lit(manners.per_host)).cast("string"))
    names, kinds = urls.columns, ", ".join(f"`{n}` {t}" for n, t in urls.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paces: dict[str, Pace] = {}

        def queue(host: str, part: pd.Series) -> list[tuple]:
            pace, out = paces[host], []

            def once(u: str) -> tuple[int, bytes]:
                pace.wait()
                return get(u)

            for at, u in part.items():
                out.append((at, *fetch_one(u, once, manners.attempts, manners.backoff_s)))
            return out

        with ThreadPoolExecutor(manners.at_once) as pool:
            for pdf in frames:
                queues = [(h or "", part[url]) for h, part in pdf.groupby(pdf["_host"].fillna(""), sort=False)]
                for h, _ in queues:
                    paces.setdefault(h, Pace(manners.pace_s * manners.per_host))
                done = [row for rows in pool.map(lambda q: queue(*q), queues) for row in rows]
                out = pd.DataFrame(done, columns=["_at", "http_status", "body", "error", "retry_count", "result"]).set_index("_at")
                yield pd.concat([pdf[names], out], axis=1)

    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return urls.withColumn("_host", key).repartition(tasks, "_host").mapInPandas(run, f"{kinds}, {FETCHED}")


TEXT_CHARS, PREVIOUS_CHARS, RE_PROMPTS = 6000, 1000, 3
INTERPRETED = "llm_status string, llm_output string, llm_raw string, llm_errors string, llm_retries int, cacheable boolean"


Checked = Callable[[object], tuple[object, list[str]]]


def interpret_one(text: str, complete: Callable[[str], str], check: Checked = answers.check) -> tuple:
    """(status, output JSON, raw, errors, retries, cacheable) of one page.

    ``check`` gives the answer in its fields' kinds, and what is wrong with it;
    the model is told all of that and asked again. A transport error on the
    first call is ``llm_unavailable`` and not cached; answers that stay invalid
    after RE_PROMPTS further calls are ``extraction_failed``.
    """
    try:
        raw = complete(text[:TEXT_CHARS])
    except Exception as e:  # the model may be unreachable in any way
        return "llm_unavailable", None, "", str(e), 0, False
    retries = 0
    while True:
        try:
            value, wrong = check(json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", raw.strip())))
        except ValueError as e:
            value, wrong = None, [f"not JSON: {e}"]
        error = "; ".join(wrong)
        if not wrong:
            return "success", json.dumps(value), raw, None, retries, True
        if retries == RE_PROMPTS:
            return "extraction_failed", None, raw, error, retries, True
        retries += 1
        try:
            raw = complete(f"{error}\n{raw[:PREVIOUS_CHARS]}")
        except Exception as e:  # as above
            return "extraction_failed", None, raw, str(e), retries, True


def interpret(pages: DataFrame, text: str, complete: Callable[[str], str], check: Checked = answers.check) -> DataFrame:
    """``pages`` with llm_status, llm_output, llm_raw, llm_errors, llm_retries and cacheable. Pages found in a cache are anti-joined first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [interpret_one(t or "", complete, check) for t in pdf[text]]
            more = pd.DataFrame(out, columns=["llm_status", "llm_output", "llm_raw", "llm_errors", "llm_retries", "cacheable"], index=pdf.index)
            yield pd.concat([pdf, more], axis=1)

    return pages.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in pages.dtypes) + ", " + INTERPRETED)


def from_cache(pages: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return pages.join(cache, key), pages.join(cache.select(key), key, "left_anti")
