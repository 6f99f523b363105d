"""Responses of a live feed of trials, with the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lick_response


def deduplicated(feed: DataFrame, *, keys: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """Rows of a stream without repeats of a key within the watermark."""
    return feed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def response_counts(feed: DataFrame, *, source: str, time: str, event: str, licks: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Trials and responses per source and tumbling window; rows later than the watermark are left out."""
    own = feed.withWatermark(time, lateness).withColumn("_l", lick_response(event, licks))
    return own.groupBy(source, F.window(time, window).alias("window")).agg(F.count("*").alias("n_trials"), F.count_if("_l.response").alias("n_responses"))
