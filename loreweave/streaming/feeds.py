"""Streaming counters, histograms, limit checks and status feeds; each has a batch twin in ``operations``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loreweave.operators.operations import histogram, rate_breaches

FEED = "document_id string, filename string, status string, error_message string, ts timestamp, before string, message string"
STARTED = "Generating document insights and adding to knowledge graph."
READY = "Ready. You can now chat about this document."
FAILED = "Processing failed. Try re-uploading or check the format."


def counters_stream(events: DataFrame, labels: list[str], period: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counts per label set and event-time window; the watermark lets old windows leave the state."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", period).alias("w"), *labels)
    return windowed.agg(F.count(F.lit(1)).alias("total")).select(F.col("w.start").alias("window_start"), *labels, "total")


def histogram_stream(
    events: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...], period: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    timed = events.withWatermark("ts", delay).withColumn("w", F.window("ts", period))
    rows = histogram(timed, ["w", *labels], value, bounds)
    return rows.withColumn("window_start", F.col("w.start")).drop("w")


def rate_breaches_stream(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """For ``update`` output: a row per limit window each time its count changes."""
    return rate_breaches(requests, limits)


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    out = []
    for row in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
        if last is not None and last != row.status:
            if last == "uploaded" and row.status == "processing":
                text = STARTED
            elif row.status == "processed":
                text = READY
            else:
                text = (row.error_message or FAILED) if row.status == "failed" else None
            if text:
                out.append((row.document_id, row.filename, row.status, row.error_message, row.ts, last, text))
        last = row.status
    state.update((last,))
    yield pd.DataFrame(out, columns=["document_id", "filename", "status", "error_message", "ts", "before", "message"])


def status_feed_stream(observations: DataFrame) -> DataFrame:
    """Status changes as they arrive; the state of a document is its last seen status."""
    rows = observations.select("document_id", "filename", "status", "error_message", "ts")
    return rows.groupBy("document_id").applyInPandasWithState(
        _changes, FEED, "status string", "append", GroupStateTimeout.NoTimeout
    )

