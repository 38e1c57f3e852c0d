"""Session aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.events import interval

BOUNCE_MS = 10_000


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def is_type(kind: str) -> Column:
    return F.col("eventType") == kind


def composite_key(*columns: str) -> Column:
    return F.concat_ws("_", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS") if c == "windowStart" else F.col(c) for c in columns))


def duration_ms(whole_seconds: bool = False) -> Column:
    if whole_seconds:
        return (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) * 1000
    return F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))


def is_bounce() -> Column:
    """One page and less than BOUNCE_MS."""
    return (F.size("uniquePages") == 1) & (F.col("durationMs") < BOUNCE_MS)


def browser(agent: Column) -> Column:
    """Family of a user agent."""
    return F.when(agent.contains("Edg/"), "Edge").when(agent.contains("Firefox/"), "Firefox").when(agent.contains("Chrome/"), "Chrome").when(agent.contains("Safari/"), "Safari").otherwise("Other")


def device(agent: Column) -> Column:
    return F.when(agent.rlike("iPad|Tablet"), "tablet").when(agent.rlike("iPhone|Android|Mobile"), "mobile").otherwise("desktop")


def session_aggregates(events: DataFrame, gap: str = "30 minutes", whole_seconds: bool = False, extended: bool = False) -> DataFrame:
    """One row for each session of a user; a gap of exactly `gap` doesn't end a session.

    Entry and exit page keep one value each instead of a session's events. extended adds eventCount, devices and browsers.
    """
    order = F.struct("ts", "eventId")
    agent = F.col("userAgent")
    more = [F.count("*").alias("eventCount"), F.sort_array(F.collect_set(device(agent))).alias("devices"), F.sort_array(F.collect_set(browser(agent))).alias("browsers")]
    grouped = events.groupBy(F.session_window("ts", interval(gap)).alias("window"), "sessionId", "userId").agg(
        duration_ms(whole_seconds).alias("durationMs"),
        count_if(is_type("PAGE_VIEW")).alias("pageViewCount"),
        count_if(is_type("CLICK")).alias("clickCount"),
        count_if(is_type("SCROLL")).alias("scrollEvents"),
        F.sort_array(F.collect_set("pageUrl")).alias("uniquePages"),
        F.min_by("pageUrl", order).alias("entryPage"),
        F.max_by("pageUrl", order).alias("exitPage"),
        *(more if extended else []),
    )
    out = grouped.withColumn("windowStart", F.col("window.start")).withColumn("windowEnd", F.col("window.end")).drop("window")
    out = out.withColumn("bounced", is_bounce()).withColumn("_compositeKey", composite_key("sessionId", "windowStart"))
    names = ["sessionId", "userId", "windowStart", "windowEnd", "durationMs", "pageViewCount", "clickCount", "scrollEvents", "uniquePages", "entryPage", "exitPage", "bounced", "_compositeKey"]
    return out.select(*names, *(["eventCount", "devices", "browsers"] if extended else []))


def session_pages(sessions: DataFrame) -> DataFrame:
    """A row for each page of each session."""
    return sessions.withColumn("pageUrl", F.explode("uniquePages"))
