"""User journeys: the pages of a session in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import interval
from .sessions import composite_key, duration_ms, is_type


def clicks_by_view(events: DataFrame) -> DataFrame:
    """Page views with clicksOnPage: each click counts for the latest view of its session before it, if that is of the same page."""
    order = Window.partitionBy("userId", "sessionId").orderBy("ts", "eventId").rowsBetween(Window.unboundedPreceding, 0)
    view = F.struct("eventId", "pageUrl")
    latest = F.last(F.when(is_type("PAGE_VIEW"), view), ignorenulls=True).over(order)
    df = events.filter(F.col("eventType").isin("PAGE_VIEW", "CLICK")).withColumn("_view", latest)
    df = df.filter(F.col("_view").isNotNull() & (is_type("PAGE_VIEW") | (F.col("_view.pageUrl") == F.col("pageUrl"))))
    grouped = df.groupBy("userId", "sessionId", F.col("_view.eventId").alias("eventId"), "pageUrl")
    return grouped.agg(F.min(F.when(is_type("PAGE_VIEW"), F.col("ts"))).alias("ts"), F.count(F.when(is_type("CLICK"), 1)).alias("clicksOnPage"))


def user_journeys(events: DataFrame, gap: str = "30 minutes", clicks: bool = False, legacy_key: bool = False, whole_seconds: bool = False) -> DataFrame:
    """Page views of each session in time order. clicks counts the clicks of every step (batch only), else the count is 0.

    legacy_key leaves the window start out of the key, so that a session's later journey replaces its earlier one.
    """
    views = clicks_by_view(events) if clicks else events.filter(is_type("PAGE_VIEW")).withColumn("clicksOnPage", F.lit(0).cast("long"))
    step = F.struct(F.col("ts").alias("timestamp"), "pageUrl", "clicksOnPage")
    out = views.groupBy(F.session_window("ts", interval(gap)).alias("window"), "userId", "sessionId").agg(F.sort_array(F.collect_list(step)).alias("steps"), duration_ms(whole_seconds).alias("totalSessionDuration"))
    pages = F.transform("steps", lambda s: F.struct(s["pageUrl"].alias("pageUrl"), s["timestamp"].alias("timestamp"), s["clicksOnPage"].alias("clicksOnPage")))
    out = out.select("userId", "sessionId", F.col("window.start").alias("windowStart"), F.col("window.end").alias("windowEnd"), pages.alias("orderedPages"), "totalSessionDuration")
    return out.withColumn("_compositeKey", composite_key(*(["userId", "sessionId"] + ["windowStart"] * (not legacy_key))))


def journey_steps(journeys: DataFrame) -> DataFrame:
    """A row for each step: its number, and the time to the next step (null for the last)."""
    steps = journeys.select("userId", "sessionId", "windowStart", "orderedPages", F.posexplode("orderedPages").alias("place", "step"))
    following = F.get(F.col("orderedPages"), F.col("place") + 1)["timestamp"]
    out = steps.withColumn("stepDurationMs", F.unix_millis(following) - F.unix_millis("step.timestamp"))
    return out.select("userId", "sessionId", "windowStart", (F.col("place") + 1).alias("sequence"), "step.pageUrl", "step.timestamp", "step.clicksOnPage", "stepDurationMs")
