"""Page metrics by tumbling window, and what joins or ranks pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import interval
from .sessions import composite_key, count_if, duration_ms, is_bounce, is_type, session_pages


def page_metrics(events: DataFrame, window: str = "5 minutes", exact: bool = True) -> DataFrame:
    """Views, clicks, visitors and mean scroll depth of each page and window. Streams need exact=False (approximate visitors)."""
    visitors = F.count_distinct("userId") if exact else F.approx_count_distinct("userId")
    out = events.groupBy(F.window("ts", interval(window)).alias("window"), "pageUrl").agg(
        count_if(is_type("PAGE_VIEW")).alias("totalViews"),
        visitors.alias("uniqueVisitors"),
        count_if(is_type("CLICK")).alias("clickCount"),
        F.avg(F.when(is_type("SCROLL"), F.col("metadata.scrollDepth"))).alias("avgScrollDepth"),
    )
    out = out.select("pageUrl", F.col("window.start").alias("windowStart"), F.col("window.end").alias("windowEnd"), "totalViews", "uniqueVisitors", "clickCount", "avgScrollDepth")
    return out.withColumn("_compositeKey", composite_key("pageUrl", "windowStart"))


def bounce_rates(sessions: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Sessions and bounce rate of each page and the window in which they start."""
    pages = session_pages(sessions).groupBy(F.window("windowStart", interval(window)).alias("window"), "pageUrl")
    return pages.agg(F.count("*").alias("sessions"), F.avg(F.col("bounced").cast("int")).alias("bounceRate")).select("pageUrl", F.col("window.start").alias("windowStart"), "sessions", "bounceRate")


def closing_bounces(events: DataFrame, gap: str = "30 minutes", window: str = "5 minutes") -> DataFrame:
    """Sessions and bounce rate of each page and the window in which they end, for streams (append mode) and batches.

    Two steps with state in one query: sessions close when the watermark passes their gap, and their end is the event time by which the second counts
    them, so a window is final once the watermark has passed it. (bounce_rates counts a session where it starts, which no stream can close.)
    """
    sessions = events.groupBy(F.session_window("ts", interval(gap)).alias("session"), "sessionId", "userId").agg(duration_ms().alias("durationMs"), F.collect_set("pageUrl").alias("uniquePages"))
    visits = sessions.select("session", is_bounce().alias("bounced"), F.explode("uniquePages").alias("pageUrl"))
    out = visits.groupBy(F.window(F.window_time("session"), interval(window)).alias("window"), "pageUrl").agg(F.count("*").alias("sessions"), F.avg(F.col("bounced").cast("int")).alias("bounceRate"))
    out = out.select("pageUrl", F.col("window.start").alias("windowStart"), F.col("window.end").alias("windowEnd"), "sessions", "bounceRate")
    return out.withColumn("_compositeKey", composite_key("pageUrl", "windowStart"))


def page_metrics_with_bounces(events: DataFrame, sessions: DataFrame, window: str = "5 minutes", exact: bool = True) -> DataFrame:
    """Page metrics with bounceRate (0 where no session starts): sessions meet the window that holds their start by equality."""
    rates = bounce_rates(sessions, window).select("pageUrl", "windowStart", "bounceRate")
    return page_metrics(events, window, exact).join(rates, ["pageUrl", "windowStart"], "left").withColumn("bounceRate", F.coalesce("bounceRate", F.lit(0.0)))


def top_by_page(events: DataFrame, column: str, k: int = 5, kind: str | None = None) -> DataFrame:
    """The k most frequent values of a column for each page (referrers, or click targets with kind='CLICK'); ties by value."""
    rows = events.filter(F.col(column).isNotNull())
    counts = (rows.filter(is_type(kind)) if kind else rows).groupBy("pageUrl", column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("pageUrl").orderBy(F.desc("n"), column))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def exit_rates(sessions: DataFrame) -> DataFrame:
    """Of the sessions that visit a page, the share that ends there."""
    return session_pages(sessions).groupBy("pageUrl").agg(F.count("*").alias("sessions"), count_if(F.col("exitPage") == F.col("pageUrl")).alias("exits")).withColumn("exitRate", F.col("exits") / F.col("sessions"))


def session_durations(sessions: DataFrame) -> DataFrame:
    """Mean duration of the sessions that visit a page."""
    return session_pages(sessions).groupBy("pageUrl").agg(F.count("*").alias("sessions"), F.avg("durationMs").alias("avgSessionDurationMs"))


def click_heatmap(events: DataFrame, bin_size: int = 100) -> DataFrame:
    """Clicks of each page by square bins of x and y."""
    bins = [F.floor(F.col(f"metadata.{c}") / bin_size).cast("int").alias(f"{c}Bin") for c in "xy"]
    return events.filter(is_type("CLICK") & F.col("metadata.x").isNotNull() & F.col("metadata.y").isNotNull()).groupBy("pageUrl", *bins).agg(F.count("*").alias("clicks"))
