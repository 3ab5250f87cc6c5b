"""Streaming forms: event-time sliding means and running lag products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("v") == rows.agg(F.max("v")).first()[0]).drop("v")


def sliding_event_mean(stream: DataFrame, duration: str, step: str, late: str, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per key and event-time window; rows later than ``late`` behind the newest are dropped by the watermark."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(ts, duration, step), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "mean", "n")


def running_lag_products(packed: DataFrame, max_lag: int) -> DataFrame:
    """subject, ci, cj, lag, c, n summed over all trials and places so far; trials come as rows with chans and xs.

    Sums only add, so the state is one row per key (output mode update or complete).
    """
    rows = packed.select("subject", F.posexplode("xs").alias("i", "xi"), "chans", "xs")
    rows = rows.select("subject", F.get("chans", F.col("i")).alias("ci"), "xi", "chans", F.posexplode("xs").alias("j", "xj"))
    rows = rows.select("subject", "ci", F.get("chans", F.col("j")).alias("cj"), "xi", "xj", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    later = F.slice("xj", F.col("lag") + 1, F.greatest(F.size("xj") - F.col("lag"), F.lit(0)))
    dot = F.aggregate(F.zip_with("xi", later, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return rows.groupBy("subject", "ci", "cj", "lag").agg(F.sum(dot).alias("c"), F.sum((F.size("xj") - F.col("lag")).cast("long")).alias("n"))
