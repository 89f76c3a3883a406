"""Latencies per minute kept as mergeable sketches, and longer windows made of them.

The minute table has a row per path and minute, whatever the traffic, with everything that adds
up: counts, an exact decimal sum, the maximum and a KLL quantile sketch. Hours and days, or any
window of whole minutes, come from that table; the log lines are read once. A stream appends the
minutes its watermark has closed.

Percentiles are exact while a group has at most ``SIZE`` latencies, and beyond that estimates:
their rank is off by at most ``RANK_ERROR`` of the group, however often sketches were merged
(five standard deviations; 99 % are within 0.0014). Null and NaN latencies count as requests
but are in no percentile; a group without others has null percentiles. Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The size parameter of the sketches, and the bound on a rank that goes with it.
SIZE = 2_000
RANK_ERROR = 0.003


def minutes(df: DataFrame, time: str = "ts", size: int = SIZE) -> DataFrame:
    """The minute table of parsed log lines, batch or stream."""
    timed = F.when(~F.isnan("latency_ms"), F.col("latency_ms"))
    grouped = df.groupBy(F.window(time, "1 minute").alias("w"), "path").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 400).alias("failures"),
        F.sum(timed.cast("decimal(28,9)")).alias("total"),
        F.count(timed).alias("timed"),
        F.max(timed).alias("max_ms"),
        F.kll_sketch_agg_double(timed, F.lit(size)).alias("sketch"),
    )
    return grouped.select(F.col("w.start").alias("minute"), "path", "requests", "failures",
                          "total", "timed", "max_ms", "sketch")


def rolled(table: DataFrame, window: str, size: int = SIZE) -> DataFrame:
    """Minutes, or what this returned for a shorter window, merged to a longer window.

    The columns are those of the minute table, so that days can be made of stored hours.
    """
    grouped = table.groupBy(F.window("minute", window).alias("w"), "path").agg(
        F.sum("requests").alias("requests"), F.sum("failures").alias("failures"),
        F.sum("total").cast("decimal(28,9)").alias("total"), F.sum("timed").alias("timed"),
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
    )
    return grouped.select(F.col("w.start").alias("minute"), "path", "requests", "failures",
                          "total", "timed", "max_ms", "sketch")


def quantile(rank: float) -> Column:
    """The latency at a rank of the sketch."""
    return F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(rank)))


def summary(table: DataFrame) -> DataFrame:
    """What ``requests.log_summary`` reports, of a table of sketches."""
    return table.select(
        F.col("minute").alias("window_start"), "path", "requests", "failures",
        F.try_divide(F.col("total").cast("double"), F.col("timed").cast("double")).alias("mean_ms"),
        quantile(0.5).alias("p50_estimate_ms"), quantile(0.95).alias("p95_estimate_ms"), "max_ms")


def rank_errors(table: DataFrame, lines: DataFrame, window: str, ranks: tuple[float, ...],
                time: str = "ts") -> DataFrame:
    """``(window_start, path, rank, error)``: how far each estimate's true rank is off, as a
    share of the group, from the parsed lines themselves. Ties cover a range of ranks."""
    estimates = table.select(F.col("minute").alias("window_start"), "path", F.explode(F.array(
        *[F.struct(F.lit(r).alias("rank"), quantile(r).alias("at")) for r in ranks])).alias("e"))
    listed = estimates.groupBy("window_start", "path").agg(F.collect_list("e").alias("e"))
    points = lines.where("latency_ms IS NOT NULL AND NOT isnan(latency_ms)").select(
        F.window(time, window)["start"].alias("window_start"), "path", "latency_ms")
    # A row per group, path and distinct latency before anything meets the estimates.
    counted = points.groupBy("window_start", "path", "latency_ms").agg(F.count("*").alias("n"))
    met = counted.join(listed, ["window_start", "path"]).withColumn("e", F.explode("e"))
    shares = met.groupBy("window_start", "path", F.col("e.rank").alias("rank")).agg(
        (F.sum(F.when(F.col("latency_ms") < F.col("e.at"), F.col("n")).otherwise(0))
         / F.sum("n")).alias("below"),
        (F.sum(F.when(F.col("latency_ms") <= F.col("e.at"), F.col("n")).otherwise(0))
         / F.sum("n")).alias("upto"))
    off = F.greatest(F.col("below") - F.col("rank"), F.col("rank") - F.col("upto"), F.lit(0.0))
    return shares.select("window_start", "path", "rank", off.alias("error"))
