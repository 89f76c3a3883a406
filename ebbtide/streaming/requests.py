"""Request counts and latencies per minute, over tables and over streams.

Every function takes a batch or a streaming DataFrame; call :func:`with_lateness`
first on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

# Requests a client may send per minute.
SCORE_LIMIT, DEFAULT_LIMIT, PLAN_LIMIT = 10, 30, 5
LOG_FIELDS = "method string, path string, status int, latency_ms double"


def with_lateness(df: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Give a stream its event time. Watermarks need an instant, so a time without zone
    is read in the session's zone."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def request_counts(
    df: DataFrame,
    limit: int = DEFAULT_LIMIT,
    window: str = "1 minute",
    time: str = "ts",
    client: str = "client",
) -> DataFrame:
    """Requests per client and tumbling window, and whether they exceed the limit.

    Counts combine in each task first, so a client that sends a large share of all
    requests costs one row per task and window in the shuffle.
    """
    counted = df.groupBy(F.window(time, window).alias("w"), F.col(client).alias("client")).agg(
        F.count("*").alias("requests")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "client", "requests", (F.col("requests") > limit).alias("over_limit"),
    )


def _read_log(df: DataFrame, line: str, time: str) -> DataFrame:
    """The line and what it says; a line that is not a JSON object with a path says nothing."""
    read = F.when(F.try_parse_json(line).isNotNull(), F.from_json(line, LOG_FIELDS))
    return df.select(time, line, read.alias("r"))


def parse_log(df: DataFrame, line: str = "line", time: str = "ts") -> DataFrame:
    """JSON log lines to ``ts, method, path, status, latency_ms``. Lines that cannot be
    read are no requests: :func:`unreadable_log` returns them."""
    return _read_log(df, line, time).filter("r.path IS NOT NULL").select(time, "r.*")


def unreadable_log(df: DataFrame, line: str = "line", time: str = "ts") -> DataFrame:
    """The lines that :func:`parse_log` leaves out."""
    return _read_log(df, line, time).filter("r.path IS NULL").select(time, line)


def log_summary(
    df: DataFrame, window: str = "1 minute", time: str = "ts", accuracy: int = 10_000
) -> DataFrame:
    """Requests, failures and latencies per path and window.

    The mean is over the requests that have a latency, from a sum of exact decimals. The
    percentiles come from mergeable sketches, whose state a stream can keep, and are
    estimates: their rank is off by at most 1 / ``accuracy`` of the group."""
    at = F.percentile_approx("latency_ms", [0.5, 0.95], accuracy)
    grouped = df.groupBy(F.window(time, window).alias("w"), "path").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 400).alias("failures"),
        F.sum(F.col("latency_ms").cast("decimal(28,9)")).alias("total"),
        F.count("latency_ms").alias("timed"),
        F.max("latency_ms").alias("max_ms"),
        at.alias("at"),
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), "path", "requests", "failures",
        F.try_divide(F.col("total").cast("double"), F.col("timed").cast("double")).alias("mean_ms"),
        F.get("at", F.lit(0)).alias("p50_estimate_ms"), F.get("at", F.lit(1)).alias("p95_estimate_ms"),
        "max_ms",
    )


def still_open(
    df: DataFrame, window: str = "1 minute", time: str = "ts", delay: str = "10 minutes"
) -> DataFrame:
    """What a stream over these rows keeps back when its input ends: ``rows`` and
    ``windows`` that the watermark has not closed."""
    closed = df.agg(F.max(time) - F.expr(f"INTERVAL {delay}")).scalar()
    waiting = df.select(F.window(time, window).alias("w")).filter(F.col("w.end") > closed)
    per_window = waiting.groupBy("w").agg(F.count("*").alias("n"))
    return per_window.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("windows"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, as far as the query's reports reach."""
    return sum(
        int(state["numRowsDroppedByWatermark"])
        for progress in query.recentProgress for state in progress["stateOperators"]
    )


def start_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a Parquet table and stop when the input is used up."""
    return (
        df.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
