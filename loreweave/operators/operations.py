"""Operational tables: rerun sets, refresh states, retries, limits, counters, histograms, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import strip
from loreweave.operators.ranking import neighbour

# Retry attempts, request limits per route, histogram bounds in seconds.
MAX_ATTEMPTS = 3
RATE_LIMITS = (
    ("register", 5, 3600),
    ("verify_email", 10, 900),
    ("resend_code", 3, 3600),
    ("login", 10, 900),
    ("forgot_password", 3, 3600),
    ("reset_password", 5, 900),
)
HTTP_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
NODE_BUCKETS = (0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
MODEL_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
RETRIEVAL_BUCKETS = (0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def rerun_outcome(requests: DataFrame, documents: DataFrame, texts: DataFrame, done: str) -> DataFrame:
    """Outcome of asking to rerun a stage (``reindexed``/``resummarized``) on documents.

    ``texts`` holds non-blank document texts (see ``chunking.rebuild_text``).
    """
    keys = ["user_id", "document_id"]
    joined = requests.join(documents.select(*keys, "status"), keys, "left").join(
        texts.select(*keys, F.lit(True).alias("_t")), keys, "left"
    )
    outcome = (
        F.when(F.col("status").isNull(), "missing").when(F.col("status") != "processed", "skipped")
        .when(F.col("_t").isNull(), "no-text").otherwise(done)
    )
    return joined.select(*requests.columns, outcome.alias("outcome"))


def refresh_state(documents: DataFrame) -> DataFrame:
    """Per user: ``fast`` while anything is queued or running, ``slow`` while a summary is due, else ``done``."""
    active = F.col("status").isin("uploaded", "processing")
    waiting = (F.col("status") == "processed") & F.col("summary_tldr").isNull()
    return documents.groupBy("user_id").agg(
        F.when(F.bool_or(active), "fast").when(F.bool_or(waiting), "slow").otherwise("done").alias("state")
    )


def retry_selection(attempts: DataFrame) -> DataFrame:
    """Last outcome per document and whether another attempt is due.

    ``attempts``: ``user_id, document_id, attempt, entities, transient``. An attempt is repeated while it
    is empty and transient, three times at most.
    """
    last = attempts.groupBy("user_id", "document_id").agg(
        F.max("attempt").alias("attempts"), F.max_by(F.struct("entities", "transient"), "attempt").alias("l")
    )
    again = (F.col("l.entities") == 0) & F.col("l.transient") & (F.col("attempts") < MAX_ATTEMPTS)
    return last.select("user_id", "document_id", "attempts", F.col("l.entities").alias("entities"), F.col("l.transient").alias("transient"), again.alias("retry"))


def forwarded_ip(header: Column, peer: Column) -> Column:
    """First address of a forwarding header, else the peer."""
    first = strip(F.element_at(F.split(header, ","), 1))
    return F.when(F.coalesce(header, F.lit("")) != "", first).otherwise(peer)


def limits_table(spark, limits=RATE_LIMITS) -> DataFrame:
    return spark.createDataFrame(list(limits), "route string, allowed int, period int")


def rate_breaches(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests per (ip, route, tumbling period) against the route's limit.

    ``requests``: ``ip, route, ts``. Works on a stream as well (the window start is an event-time bucket);
    ``limits`` is a handful of fixed rows.
    """
    timed = requests.join(limits, "route")
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / F.col("period")) * F.col("period"))
    counts = timed.groupBy("ip", "route", "allowed", "period", start.alias("window_start")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.withColumn("breached", F.col("requests") > F.col("allowed"))


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def histogram(rows: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative fixed-bucket histogram in long form: ``labels, le, observations, total, value_sum``.

    Buckets are columns of one aggregate and unpivoted afterwards, so each row is read once and shuffled
    data is one row per label set and task.
    """
    names = [f"b{i}" for i in range(len(bounds))]
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(n) for n, b in zip(names, bounds)]
    wide = rows.groupBy(*labels).agg(*sums, F.count(value).alias("total"), F.sum(value).alias("value_sum"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(n).alias("observations")) for n, b in zip(names, bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("observations")))
    return wide.select(*labels, F.inline(F.array(*pairs)), "total", "value_sum")


def status_feed(observations: DataFrame, block: int = 86_400_000_000) -> DataFrame:
    """Messages for status changes (``document_id, filename, status, error_message, ts``).

    The first sighting of a document is silent, as is every repeat of the last seen status.
    """
    numbered = observations.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    seen = neighbour(numbered, ["document_id"], "_at", {"before": "status"}, block=block, following=False)
    failed = F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.lit("Processing failed. Try re-uploading or check the format."))
    message = (
        F.when((F.col("before") == "uploaded") & (F.col("status") == "processing"), "Generating document insights and adding to knowledge graph.")
        .when(F.col("status") == "processed", "Ready. You can now chat about this document.")
        .when(F.col("status") == "failed", failed)
    )
    return (
        seen.filter(F.col("before").isNotNull() & (F.col("before") != F.col("status"))).withColumn("message", message)
        .filter(F.col("message").isNotNull()).drop("_at")
    )
