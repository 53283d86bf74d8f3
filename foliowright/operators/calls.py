"""Calls of remote services from inside a partition: a bounded window in flight, answers in order, backoff, a rate limit."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import mulberry32

# Statuses of a refusal that is worth another attempt, beside all from 500 on.
AGAIN = (408, 409, 429)


class Refused(Exception):
    """A service's refusal: its status, and how long it asks to wait, in seconds."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


@dataclass(frozen=True)
class Policy:
    """How often and how fast a service is asked. ``unit`` is the length of a second: 0 in a dry run, which computes waits only."""

    in_flight: int = 16
    attempts: int = 6
    first_wait: float = 1.0
    longest_wait: float = 30.0
    longest_asked: float = 60.0
    jitter: float = 0.25
    per_second: float | None = None
    burst: int = 1
    seed: int = 7
    unit: float = 1.0

    def wait(self, request: int, attempt: int, asked: float | None = None) -> float:
        """Seconds before the attempt after ``attempt`` (from 1): what the service asks, else doubling waits with jitter.

        The jitter is drawn from a counter by request and attempt, so it is the same in every run.
        """
        if asked is not None:
            return min(max(asked, 0.0), self.longest_asked)
        u = float(mulberry32(self.seed, 1, request * self.attempts + attempt)[0])
        return min(self.longest_wait, self.first_wait * 2 ** (attempt - 1)) * (1 + self.jitter * (2 * u - 1))


class TokenBucket:
    """Lets ``per_second`` calls through, ``burst`` at once; one for each worker process and name."""

    _all: dict[str, TokenBucket] = {}
    _lock = threading.Lock()

    def __init__(self, per_second: float, burst: int, clock=time.monotonic):
        self.rate, self.burst, self.clock = per_second, burst, clock
        self.held, self.at, self.lock = float(burst), clock(), threading.Lock()

    @classmethod
    def named(cls, name: str, per_second: float, burst: int) -> TokenBucket:
        with cls._lock:
            if name not in cls._all:
                cls._all[name] = cls(per_second, burst)
            return cls._all[name]

    def take(self) -> float:
        """Takes a token, in debt if there is none; returns the seconds until it is there."""
        with self.lock:
            now = self.clock()
            self.held = min(self.burst, self.held + (now - self.at) * self.rate)
            self.at = now
            self.held -= 1
            return max(0.0, -self.held / self.rate)


@dataclass
class Outcome:
    answer: str | None
    attempts: int
    waited: float
    error: str | None


def ask(number: int, request: str, send: Callable[[str], str], policy: Policy, bucket: TokenBucket | None = None, sleep=time.sleep) -> Outcome:
    """One request with its attempts. What is no refusal, or one that is not worth another attempt, ends it."""
    waited = 0.0
    for attempt in range(1, policy.attempts + 1):
        if bucket:
            sleep(bucket.take() * policy.unit)
        try:
            return Outcome(send(request), attempt, waited, None)
        except Refused as e:
            if attempt == policy.attempts or not (e.status in AGAIN or e.status >= 500):
                return Outcome(None, attempt, waited, str(e))
            pause = policy.wait(number, attempt, e.retry_after)
            waited += pause
            sleep(pause * policy.unit)
        except Exception as e:  # noqa: BLE001  one request's failure is its row's, not the partition's
            return Outcome(None, attempt, waited, f"{type(e).__name__}: {e}")
    return Outcome(None, 0, 0.0, "no attempts")


def in_order(requests: Iterable[tuple[int, str]], send: Callable[[str], str], policy: Policy, bucket: TokenBucket | None = None, sleep=time.sleep) -> Iterator[Outcome]:
    """Outcomes in the order of the requests, at most ``in_flight`` of which are open; none is read ahead of that."""
    with ThreadPoolExecutor(policy.in_flight) as pool:
        window: deque = deque()
        for number, request in requests:
            if len(window) >= policy.in_flight:
                yield window.popleft().result()
            window.append(pool.submit(ask, number, request, send, policy, bucket, sleep))
        while window:
            yield window.popleft().result()


def called(df: DataFrame, number: str, request: str, service: Callable[[], Callable[[str], str]], policy: Policy = Policy(), name: str = "service") -> DataFrame:
    """Adds answer, attempts, waited and error to every row; a null request is not sent.

    ``service`` makes the function that sends, once a partition (a client with its connections). ``number`` is a column of
    whole numbers by which jitter is drawn. Partitions times ``in_flight`` is what a cluster has open at once: deal rows
    to as many partitions as the service bears. A lost executor's partition is asked again.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = [df.columns.index(c) for c in (number, request)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = service()
        bucket = TokenBucket.named(name, policy.per_second, policy.burst) if policy.per_second else None
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in at), strict=True))
            out = in_order(((n or 0, r) for n, r in rows if r is not None), send, policy, bucket)
            made = [next(out) if r is not None else Outcome(None, 0, 0.0, None) for _, r in rows]
            cols = [pa.array([getattr(o, f) for o in made], t) for f, t in (("answer", pa.string()), ("attempts", pa.int32()), ("waited", pa.float64()), ("error", pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "answer", "attempts", "waited", "error"])

    return df.withColumn(number, F.col(number).cast("long")).mapInArrow(run, kinds.replace(f"`{number}` {df.schema[number].dataType.simpleString()}", f"`{number}` bigint") + ", answer string, attempts int, waited double, error string")
