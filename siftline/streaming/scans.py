"""The detectors over streams of whole scans, and windows over the actions.

A policy needs every observation of its scan, so a stream carries scans (texts as an array), not single
texts: each micro-batch is decided like a table. Detectors keep no state between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import evidence, policy


def decide_batch(scans: DataFrame, profiles: list[str]) -> DataFrame:
    """Decisions of scans (scan_id, texts array<string>)."""
    texts = scans.select("scan_id", F.posexplode("texts").alias("place", "text"))
    observations = evidence.merge_observations(D.observe(texts, F.col("scan_id"), F.col("place"), F.col("text")))
    found = evidence.deduplicate(D.all_findings(observations))
    return policy.decide(scans.select("scan_id").distinct(), found, profiles)


def decide_stream(scans: DataFrame, profiles: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A running query that hands each batch's decisions to ``sink`` (which must tolerate a batch given again)."""
    return scans.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: sink(decide_batch(batch, profiles), number)).trigger(availableNow=True).start()


def without_repeats(scans: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drops scans whose id came before within the watermark."""
    return scans.withWatermark(time, delay).dropDuplicatesWithinWatermark(["scan_id"])


def actions_by_hour(events: DataFrame, time: str = "ts", action: str = "action", delay: str = "1 hour") -> DataFrame:
    """Numbers of actions in tumbling hours; the same on a stream and on a table."""
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    return events.groupBy(F.window(time, "1 hour").alias("w"), action).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), action, "n")
