"""The completed set as a fold of an event log: the latest edit of each (user, item), in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMOVALS = ("purchase", "logout")
ITEMS = 50


def edits(events: DataFrame) -> DataFrame:
    """user_id, item, ts, event_id, adds: an event adds an item to its user's set or takes it away."""
    return events.select("user_id", (F.col("event_id") % ITEMS).alias("item"), "ts", "event_id", (~F.col("event_type").isin(*REMOVALS)).alias("adds"))


def latest(log: DataFrame) -> DataFrame:
    """user_id, item, completed: the state after the last edit; works on a stream too (update or complete mode)."""
    return log.groupBy("user_id", "item").agg(F.max_by("adds", F.struct("ts", "event_id")).alias("completed"))
