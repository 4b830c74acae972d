"""The log tables that one watches live, as Structured Streaming jobs over a stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from searchlight.functions import agents as A
from searchlight.operators import weblog as W


def stream_classify(requests: DataFrame, profile: DataFrame, ranges: DataFrame) -> DataFrame:
    """Classifies each request as it comes, with what the last batch run knew of its IP.

    ``profile`` has ip, hits, admin_share of that run (total hits are their sum), ``ranges`` the published networks. An
    IP that the run has not seen counts as new: no hits, no admin share.
    """
    known = profile.select("ip", F.col("hits").alias("ip_hits"), "admin_share").join(W.verify_bot_ip(profile, ranges), "ip", "left")
    total = profile.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    joined = W.with_purpose(requests).join(known, "ip", "left")
    verdict = W.classify(F.coalesce("user_agent", F.lit("")), F.coalesce("ip_hits", F.lit(0)), F.lit(total), F.coalesce("admin_share", F.lit(0.0)), F.col("verified_class"), F.col("verified_agent"))
    return joined.withColumn("verdict", verdict).select(*requests.columns, "purpose", "content_type", "verdict.class", "verdict.agent", "verdict.automated")


def classify_batches(requests: DataFrame, profile: Callable[[], DataFrame], ranges: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A stream that classifies each batch with the profile and ranges of its time: both are read anew for every batch.

    ``profile`` and ``ranges`` read the last batch run's tables, so an IP that a run finds suspicious is so from the next batch
    on, without a restart. ``write`` gets the classified rows and the batch's number, which is the same if a batch is tried again.
    The caller sets the checkpoint and starts it.
    """
    return requests.writeStream.foreachBatch(lambda batch, number: write(stream_classify(batch, profile(), ranges()), number))


def stream_crawl_trend(classified: DataFrame, late: str = "2 hours") -> DataFrame:
    """Requests a day and class. In update mode a day's row is given again as it grows, in append mode once it is over; rows that come later than ``late`` are left out."""
    day = F.window("ts", "1 day")
    by = [F.count_if(F.col("class") == c).alias(c) for c in W.CLASSES]
    return classified.withWatermark("ts", late).groupBy(day.alias("w")).agg(F.count("*").alias("total"), *by).select(F.to_date("w.start").alias("day"), "total", *W.CLASSES)


def stream_error_alerts(requests: DataFrame, late: str = "2 hours", least: int = 3) -> DataFrame:
    """Per hour and URL: requests, 404 and 5xx answers, and how urgent they are; windows are updated as rows come."""
    server = F.count_if(F.col("status").isin(500, 502, 503, 504))
    missing = F.count_if(F.col("status") == 404)
    rolled = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "url").agg(F.count("*").alias("hits"), server.alias("s5xx"), missing.alias("s404"))
    probe = A.url_purpose(F.col("url")) == "scanner_probe"
    share = F.col("s5xx") / F.col("hits")
    found = rolled.where(((F.col("s5xx") >= 1) & (share >= 0.05)) | ((F.col("s404") >= least) & ~probe))
    urgency = F.when((F.col("s5xx") >= 10) & (share >= 0.10), W.P1).when((F.col("s5xx") >= 1) | (F.col("s404") >= 10), W.P2).otherwise(W.P3)
    return found.select(F.col("w.start").alias("hour"), "url", "hits", "s5xx", "s404", urgency.alias("urgency"))
