"""Any model as a scorer of calls: attempts with backoff inside mapInPandas, and a taxonomy of errors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds to wait after the first failed attempt, the second, and so on; as many attempts as there are waits.
WAITS = (2, 4, 8, 16, 32, 60)
#: HTTP states that no repetition mends, and those that one may.
FATAL_STATES, PASSING_STATES = (400, 401, 403, 404), (408, 409, 429)
ATTEMPT = "call_id string, attempt int, status string, http_status int, error string, waited double, answer string"


class ScorerError(Exception):
    """A failed attempt: http_status (None for a lost connection) and the wait that the other side asks for, in seconds."""

    def __init__(self, message: str, http_status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.http_status, self.retry_after = http_status, retry_after

    @property
    def fatal(self) -> bool:
        """Whether repeating is of no use; unknown client errors are."""
        s = self.http_status
        return s is not None and (s in FATAL_STATES or (s < 500 and s not in PASSING_STATES))


class FatalScorerError(RuntimeError):
    """Stops the run: the task fails, and the job with it once Spark's own task attempts are used up."""


def waits(call_id: str, attempt: int, retry_after: float | None, jitter: float) -> float:
    """Seconds to wait after a failed attempt: the schedule within +-jitter by the call's own random numbers, or what is asked for."""
    draw = np.random.default_rng([attempt, *call_id.encode()]).uniform(1 - jitter, 1 + jitter)
    return max(WAITS[attempt - 1] * draw, retry_after or 0.0)


def _score(scorer: Callable[[dict], str | None], jitter: float, sleep: Callable[[float], None], stop: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for call in batch.to_dict("records"):
            for attempt in range(1, len(WAITS) + 1):
                try:
                    rows.append((call["call_id"], attempt, "ok", None, None, 0.0, scorer(call | {"attempt": attempt})))
                    break
                except ScorerError as e:
                    if e.fatal and stop:
                        raise FatalScorerError(f"call {call['call_id']}: {e}") from e
                    wait = waits(call["call_id"], attempt, e.retry_after, jitter) if not e.fatal and attempt < len(WAITS) else 0.0
                    rows.append((call["call_id"], attempt, "fatal" if e.fatal else "error", e.http_status, str(e)[:300], wait, None))
                    if e.fatal:
                        break
                    sleep(wait)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ATTEMPT.split(", ")])
        out["http_status"] = pd.array(out["http_status"], dtype="Int32")
        yield out.astype({"attempt": "int32"})


def attempt_calls(
    calls: DataFrame, scorer: Callable[[dict], str | None], jitter: float = 0.1, sleep: Callable[[float], None] = time.sleep, stop_on_fatal: bool = True
) -> DataFrame:
    """One row per attempt of every call (call_id and whatever else the scorer wants to see).

    The scorer gets the call's columns and the number of the attempt, and returns its answer or raises ScorerError. A
    passing error is repeated after a growing wait, up to as many attempts as WAITS has; a fatal one stops the run, or
    with stop_on_fatal off ends the call. Materialise the result before it is used twice: a scorer is asked again otherwise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _score(scorer, jitter, sleep, stop_on_fatal, batches)

    return calls.withColumn("call_id", F.col("call_id").cast("string")).mapInPandas(run, ATTEMPT)


def finished_calls(attempts: DataFrame) -> DataFrame:
    """(call_id, attempt, answer): the calls that enter the log; failed ones stay out and are sent again by the next session."""
    return attempts.filter("status = 'ok'").select("call_id", "attempt", "answer")
