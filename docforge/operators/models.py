"""Calls of a language model as a pluggable function, with throttle, retry and dead letters (Y-2, Q-12, A-18)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str], str]


class Bucket:
    """A token bucket of requests and tokens a minute, refilled by the time that has passed; a rate-limit error pauses it."""

    def __init__(self, rpm: float, tpm: float, pause: float = 15.0, now: Callable[[], float] = time.monotonic):
        self.rpm, self.tpm, self.pause, self.now = rpm, tpm, pause, now
        self.requests, self.tokens, self.at, self.until = rpm, tpm, now(), 0.0

    def wait(self, tokens: int) -> float:
        """Seconds until a request of so many tokens may start; 0 takes it."""
        t = self.now()
        self.requests = min(self.rpm, self.requests + self.rpm * (t - self.at) / 60)
        self.tokens = min(self.tpm, self.tokens + self.tpm * (t - self.at) / 60)
        self.at = t
        if t < self.until:
            return self.until - t
        need = min(tokens, self.tpm)
        if self.requests >= 1 and self.tokens >= need:
            self.requests -= 1
            self.tokens -= need
            return 0.0
        return max((1 - self.requests) * 60 / self.rpm, (need - self.tokens) * 60 / self.tpm, 0.001)

    def limited(self) -> None:
        self.until = self.now() + self.pause


class RateLimited(Exception):
    """Raised by a call that the provider turned away."""


def answered(df: DataFrame, make: Callable[[], Call], prompt: str = "prompt", attempts: int = 3, rpm: float = 1e9, tpm: float = 1e12) -> DataFrame:
    """``df`` with answer, attempts and error. ``make`` builds the call once a partition; a row is tried ``attempts`` times,
    and one that fails keeps its error, so it can be written apart or tried again. Limits hold for each partition."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", answer string, attempts int, error string"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, bucket = make(), Bucket(rpm, tpm)
        for pdf in pdfs:
            answers, tries, errors = [], [], []
            for p in pdf[prompt]:
                answer = error = None
                for n in range(1, attempts + 1):
                    while (s := bucket.wait(len(p or "") // 4)) > 0:
                        time.sleep(min(s, 1.0))
                    try:
                        answer, error = call(p), None
                        break
                    except RateLimited:
                        bucket.limited()
                        error = "RateLimited"
                    except Exception as e:
                        error = type(e).__name__
                answers.append(answer)
                tries.append(n)
                errors.append(error)
            yield pdf.assign(answer=answers, attempts=pd.Series(tries, index=pdf.index, dtype="int32"), error=errors)

    return df.mapInPandas(run, schema)


def status_counts(df: DataFrame) -> DataFrame:
    """One row: requests started, answered, failed and turned away (A-18)."""
    return df.agg(F.count(F.lit(1)).alias("started"), F.count_if(F.expr("error is null")).alias("succeeded"), F.count_if(F.expr("error is not null")).alias("failed"), F.count_if(F.expr("error = 'RateLimited'")).alias("rate_limited"))


def throttled_starts(arrivals: list[tuple[float, int]], rpm: float, tpm: float) -> list[float]:
    """When each request (arrival, tokens), in order, would start under the limits: the throttle as a fold (Y-2)."""
    clock = [0.0]
    b, out = Bucket(rpm, tpm, now=lambda: clock[0]), []
    for at, tokens in arrivals:
        clock[0] = max(clock[0], at)
        while (s := b.wait(tokens)) > 0:
            clock[0] += s
        out.append(clock[0])
    return out
