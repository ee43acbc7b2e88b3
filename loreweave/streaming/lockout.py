"""Login lockout: a failure counter per account that opens with the first failure and expires on its own.

Attempts: ``email, ts, success``; a null ``success`` is the right password of an account that isn't verified yet, which
neither counts nor clears. Output adds ``outcome`` (ok, failed, unverified, locked), ``failures`` (counter after
the attempt) and ``retry_after`` seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loreweave.operators.ranking import carry_forward, neighbour

# Failures until lockout, life of the counter in seconds.
THRESHOLD, WINDOW = 5, 900
WINDOW_US = WINDOW * 1_000_000

OUT = "email string, ts timestamp, success boolean, outcome string, failures int, retry_after long"


def advance(count: int, opened: int, at: int, success: bool | None) -> tuple[int, int, str, int]:
    """One attempt at microsecond ``at``: new counter, its opening time, outcome, seconds left."""
    if count and at >= opened + WINDOW_US:
        count = 0
    if count >= THRESHOLD:
        return count, opened, "locked", max(0, (opened + WINDOW_US - at + 500_000) // 1_000_000)
    if success is None:
        return count, opened, "unverified", 0
    if success:
        return 0, 0, "ok", 0
    return count + 1, opened if count else at, "failed", 0


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Attempts sorted by (account, run, time); only one counter is held at a time."""
    key, count, opened = None, 0, 0
    for pdf in batches:
        outcome, failures, left = [], [], []
        for email, run, at, ok in zip(pdf["email"], pdf["run"], pdf["at"], pdf["success"]):
            if (email, run) != key:
                key, count, opened = (email, run), 0, 0
            count, opened, what, wait = advance(count, opened, int(at), None if pd.isna(ok) else bool(ok))
            outcome.append(what)
            failures.append(count)
            left.append(wait)
        yield pdf[["email", "ts", "success"]].assign(outcome=outcome, failures=failures, retry_after=left)


def lockout(attempts: DataFrame) -> DataFrame:
    """Batch form. A pause of 900 seconds always clears the counter, so an account's history is cut into
    independent runs at such pauses; runs, not accounts, are the unit of work and stream through a task
    in sorted Arrow batches with constant memory."""
    day = 86_400_000_000
    rows = attempts.select(F.lower("email").alias("email"), "ts", "success", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    gaps = neighbour(rows, ["email"], "at", {"before": "at"}, block=day, following=False)
    opens = F.when(F.col("before").isNull() | (F.col("at") - F.col("before") >= WINDOW_US), F.col("at"))
    runs = carry_forward(gaps.withColumn("run", opens), ["email"], "at", "run", block=day)
    ordered = runs.repartition("email", "run").sortWithinPartitions("email", "run", "at", F.col("success").asc_nulls_last())
    return ordered.select("email", "ts", "success", "at", "run").mapInPandas(_walk, OUT)


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Streaming state of one account: (counter, opening time)."""
    if state.hasTimedOut:
        state.remove()
        return
    count, opened = state.get if state.exists else (0, 0)
    rows = pd.concat(list(frames)).sort_values(["at", "success"], kind="stable")
    outcome, failures, left = [], [], []
    for at, ok in zip(rows["at"], rows["success"]):
        count, opened, what, wait = advance(count, opened, int(at), None if pd.isna(ok) else bool(ok))
        outcome.append(what)
        failures.append(count)
        left.append(wait)
    if count:
        state.update((count, opened))
        wake = (opened + WINDOW_US) // 1000
        if wake > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(wake)
    elif state.exists:
        state.remove()
    yield rows[["email", "ts", "success"]].assign(outcome=outcome, failures=failures, retry_after=left)


def lockout_stream(attempts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming form: one small state per account with an open counter, dropped by an event-time timer.
    Attempts later than the watermark are outside the state's reach and are dropped before it."""
    rows = attempts.withWatermark("ts", delay).select(
        F.lower("email").alias("email"), "ts", "success", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    return rows.groupBy("email").applyInPandasWithState(
        _step, OUT, "failures int, opened long", "append", GroupStateTimeout.EventTimeTimeout
    )
