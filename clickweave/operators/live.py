"""Trailing live metrics relative to an instant, and their series over time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import interval, micros
from .sessions import count_if, is_type

USERS_MS, CLICKS_MS, RATE_MS, PAGES_MS = 300_000, 60_000, 60_000, 900_000
TOP_PAGES = 10


def _age(as_of_ms: Column | int) -> Column:
    return (as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)) - F.unix_millis("ts")


def _recent(events: DataFrame, as_of_ms: Column | int, span_ms: int) -> DataFrame:
    """Events of less than span_ms of age; the first filter, on ts alone, reaches the scan and prunes it."""
    limit = F.lit(as_of_ms - span_ms) if not isinstance(as_of_ms, Column) else as_of_ms - span_ms
    return events.filter((F.col("ts") >= F.timestamp_millis(limit)) & (_age(as_of_ms) < span_ms))


def live_snapshot(events: DataFrame, as_of_ms: Column | int, users_ms: int = USERS_MS, clicks_ms: int = CLICKS_MS, rate_ms: int = RATE_MS) -> DataFrame:
    """One row, zeros without events: users of less than users_ms of age, clicks and events of less than clicks_ms, each a second.

    Ages are compared strictly; events after as_of count. Events are counted in the clicks window and divided by rate_ms.
    """
    age = _age(as_of_ms)
    return _recent(events, as_of_ms, max(users_ms, clicks_ms)).agg(
        F.count_distinct(F.when(age < users_ms, F.col("userId"))).cast("int").alias("activeUsers"),
        (count_if(is_type("CLICK") & (age < clicks_ms)) / F.lit(clicks_ms / 1000.0)).alias("clicksPerSecond"),
        (count_if(age < clicks_ms) / F.lit(rate_ms / 1000.0)).alias("eventRate"),
    ).withColumn("computedAt", as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms).cast("long"))


def trending_pages(events: DataFrame, as_of_ms: Column | int, pages_ms: int = PAGES_MS, k: int = TOP_PAGES) -> DataFrame:
    """The k pages with most events (of any type) of less than pages_ms of age; ties by page."""
    counts = _recent(events, as_of_ms, pages_ms).groupBy("pageUrl").agg(F.count("*").cast("int").alias("viewCount"))
    return counts.orderBy(F.desc("viewCount"), "pageUrl").limit(k)


def _panes(width: str, slide: str) -> tuple[int, int, int]:
    """Microseconds of a pane (what width and slide have in common), of the slide, and panes of a window."""
    w, s = micros(width), micros(slide)
    pane = math.gcd(w, s)
    return pane, s, w // pane


def _windows(panes: DataFrame, width: str, slide: str) -> DataFrame:
    """A row for each window that holds a pane: adds _j, the panes of the window before it, and _start."""
    pane, slide_us, k = _panes(width, slide)
    out = panes.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_start", F.col("pane") - F.col("_j").cast("long") * pane)
    return out.filter(F.col("_start") % slide_us == 0) if pane != slide_us else out


def metric_series(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Users, clicks and events of each sliding window that has events.

    Events are counted once by user and pane, before the shuffle where they meet. A user counts in a window in the first pane of it that has the user:
    where the user's pane before lies out of the window. So panes are counted by that distance, and only these counts (a pane has as many as a window has
    panes) become windows: neither events nor users are repeated for windows that overlap.
    """
    pane, _, k = _panes(width, slide)
    start = F.col("_us") - F.pmod(F.col("_us"), F.lit(pane).cast("long"))
    seen = events.select("userId", "eventType", F.unix_micros("ts").alias("_us")).groupBy("userId", start.alias("pane")).agg(count_if(is_type("CLICK")).alias("clicks"), F.count("*").alias("events"))
    before = F.lag("pane").over(Window.partitionBy("userId").orderBy("pane"))
    far = F.least(F.lit(k), F.coalesce(F.floor((F.col("pane") - before) / pane), F.lit(k)))
    counts = seen.withColumn("far", far.cast("int")).groupBy("pane", "far").agg(F.count("userId").alias("users"), F.sum("clicks").alias("clicks"), F.sum("events").alias("events"))
    out = _windows(counts, width, slide).groupBy("_start").agg(
        F.coalesce(F.sum(F.when(F.col("far") > F.col("_j"), F.col("users"))), F.lit(0)).alias("activeUsers"), F.sum("clicks").alias("clicks"), F.sum("events").alias("events")
    )
    return _bounded(out, width).select("windowStart", "windowEnd", "activeUsers", "clicks", "events")


def _bounded(rows: DataFrame, width: str) -> DataFrame:
    return rows.withColumns({"windowStart": F.timestamp_micros("_start"), "windowEnd": F.timestamp_micros(F.col("_start") + F.lit(micros(width)))})


def live_panes(events: DataFrame, pane: str = "1 minute", tracked: int = 10_000, lg_config: int = 12) -> DataFrame:
    """All live metrics in one row a pane, for batches and streams: events, clicks, a sketch of users and one of pages.

    Both sketches can be merged and are bounded: that of users holds 2^lg_config registers, that of pages the counts of `tracked` pages (exact
    while a pane, or what is merged, has no more pages than three quarters of them).
    """
    out = events.groupBy(F.window("ts", interval(pane)).alias("window")).agg(
        F.count("*").alias("events"),
        count_if(is_type("CLICK")).alias("clicks"),
        F.hll_sketch_agg("userId", F.lit(lg_config)).alias("users"),
        F.expr(f"approx_top_k_accumulate(pageUrl, {int(tracked)})").alias("pages"),
    )
    out = out.select(F.col("window.start").alias("windowStart"), F.col("window.end").alias("windowEnd"), "events", "clicks", "users", "pages")
    return out.withColumn("_compositeKey", F.date_format("windowStart", "yyyy-MM-dd HH:mm:ss.SSS"))


def _trailing(panes: DataFrame, as_of: Column, span_ms: int) -> DataFrame:
    """Panes of the span before as_of: what a pane holds counts from the pane's end on."""
    return panes.filter((F.col("windowStart") >= F.timestamp_millis(F.unix_millis(as_of) - span_ms)) & (F.col("windowEnd") <= as_of))


def snapshot_of(panes: DataFrame, as_of: Column, users_ms: int = USERS_MS, clicks_ms: int = CLICKS_MS, rate_ms: int = RATE_MS) -> DataFrame:
    """The live snapshot at the end of a pane, from panes: users (approximate) of users_ms, clicks and events of clicks_ms and rate_ms, each a second."""
    inside = lambda ms: F.col("windowStart") >= F.timestamp_millis(F.unix_millis(as_of) - ms)
    return _trailing(panes, as_of, max(users_ms, clicks_ms, rate_ms)).agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(inside(users_ms), F.col("users")))), F.lit(0)).cast("int").alias("activeUsers"),
        (F.coalesce(F.sum(F.when(inside(clicks_ms), F.col("clicks"))), F.lit(0)) / F.lit(clicks_ms / 1000.0)).alias("clicksPerSecond"),
        (F.coalesce(F.sum(F.when(inside(rate_ms), F.col("events"))), F.lit(0)) / F.lit(rate_ms / 1000.0)).alias("eventRate"),
    ).withColumn("computedAt", F.unix_millis(as_of))


def trending_of(panes: DataFrame, as_of: Column, pages_ms: int = PAGES_MS, k: int = TOP_PAGES, tracked: int = 10_000) -> DataFrame:
    """The k pages with most events in the span before the end of a pane, from panes; ties by page."""
    # one group and not a total: Spark can't combine the sketches of partitions without any
    merged = _trailing(panes, as_of, pages_ms).groupBy(F.lit(1).alias("all")).agg(F.expr(f"approx_top_k_combine(pages, {int(tracked)})").alias("pages"))
    # ties at the last place are settled by page, so all that is tracked is looked at: a bounded number
    rows = merged.select(F.expr(f"inline(approx_top_k_estimate(pages, {int(tracked)}))").alias("pageUrl", "viewCount"))
    return rows.select("pageUrl", F.col("viewCount").cast("int").alias("viewCount")).orderBy(F.desc("viewCount"), "pageUrl").limit(k)


def windows_of(panes: DataFrame, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """windowStart of every window that holds one of the panes, once."""
    us, pane = F.unix_micros("windowStart"), _panes(width, slide)[0]
    starts = _windows(panes.select((us - F.pmod(us, F.lit(pane).cast("long"))).alias("pane")).distinct(), width, slide)
    return starts.select(F.timestamp_micros("_start").alias("windowStart")).distinct()


def series_of(panes: DataFrame, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Users (approximate), clicks and events of each sliding window, from panes of what width and slide have in common (or of a part of that)."""
    pane, _, _ = _panes(width, slide)
    us = F.unix_micros("windowStart")
    joined = panes.groupBy((us - F.pmod(us, F.lit(pane).cast("long"))).alias("pane")).agg(F.hll_union_agg("users").alias("users"), F.sum("clicks").alias("clicks"), F.sum("events").alias("events"))
    out = _windows(joined, width, slide).groupBy("_start").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("activeUsers"), F.sum("clicks").alias("clicks"), F.sum("events").alias("events"))
    return _bounded(out, width).select("windowStart", "windowEnd", "activeUsers", "clicks", "events")


def metric_changes(series: DataFrame, metrics: tuple[str, ...] = ("activeUsers", "clicks", "events")) -> DataFrame:
    """Percent change of each metric against the window before (null where there is none or it is 0).

    The window before is found by an equi-join on the window's end, so no partition holds the whole series.
    """
    before = series.select(F.col("windowEnd").alias("windowStart"), *(F.col(m).alias(f"_{m}") for m in metrics))
    joined = series.join(before, "windowStart", "left")
    return joined.select("windowStart", "windowEnd", *metrics, *(F.when(F.col(f"_{m}") > 0, (F.col(m) - F.col(f"_{m}")) * 100.0 / F.col(f"_{m}")).alias(f"{m}Change") for m in metrics))


def users_before(events: DataFrame, span_ms: int = USERS_MS) -> DataFrame:
    """Events with the number of the same user's events in the span_ms before and at them."""
    order = Window.partitionBy("userId").orderBy("timestamp").rangeBetween(-span_ms, 0)
    return events.select("eventId", "userId", "timestamp", F.count("*").over(order).alias("recent"))
