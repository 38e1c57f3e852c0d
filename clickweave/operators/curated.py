"""Filtered, sorted and paged queries over the curated tables (sessions, page metrics, journeys)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SIZE, DEFAULT_SIZE, DEFAULT_TOP = 100, 20, 10
Time = datetime.datetime | str


def check_page(page: int = 0, size: int = DEFAULT_SIZE) -> None:
    if page < 0:
        raise ValueError("page must be 0 or more")
    if not 1 <= size <= MAX_SIZE:
        raise ValueError(f"size must lie in 1 to {MAX_SIZE}")


def in_range(df: DataFrame, start: Time | None, end: Time | None) -> DataFrame:
    """windowStart within both bounds, inclusive; a range applies only if both are given."""
    if start is None or end is None:
        return df
    start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if "date" in df.columns:  # a table written for lookups: its folders outside the range aren't read
        df = df.filter(F.col("date").between(F.to_date(start), F.to_date(end)))
    return df.filter(F.col("windowStart").between(start, end))


def select_rows(df: DataFrame, start: Time | None = None, end: Time | None = None, **equal: str | None) -> DataFrame:
    """Rows that equal all given column values and lie in the range."""
    for column, value in equal.items():
        df = df if value is None else df.filter(F.col(column) == value)
    return in_range(df, start, end)


def newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("windowStart"), "_compositeKey")


def page_of(df: DataFrame, page: int = 0, size: int = DEFAULT_SIZE) -> DataFrame:
    """A page of the rows, newest first."""
    check_page(page, size)
    return newest(df).offset(page * size).limit(size)


def page_after(df: DataFrame, after: tuple[datetime.datetime, str] | None = None, size: int = DEFAULT_SIZE) -> DataFrame:
    """The page that follows a row (its windowStart and _compositeKey), newest first: as page_of, without sorting the pages before it. Folders of later days aren't read."""
    check_page(0, size)
    if after is not None:
        start, key = F.lit(after[0]).cast("timestamp"), after[1]
        if "date" in df.columns:
            df = df.filter(F.col("date") <= F.to_date(start))
        df = df.filter((F.col("windowStart") <= start) & ((F.col("windowStart") < start) | (F.col("_compositeKey") > key)))
    return newest(df).limit(size)


def envelope(df: DataFrame, page: int = 0, size: int = DEFAULT_SIZE) -> DataFrame:
    """One row: page, size, totalElements, totalPages, hasNext, hasPrevious; a page after the last has correct totals."""
    check_page(page, size)
    pages = F.ceil(F.col("totalElements") / size)
    out = df.agg(F.count("*").alias("totalElements")).withColumn("totalPages", pages)
    return out.select(F.lit(page).alias("page"), F.lit(size).alias("size"), "totalElements", "totalPages", (F.lit(page + 1) < F.col("totalPages")).alias("hasNext"), F.lit(page > 0).alias("hasPrevious"))


def sessions(df: DataFrame, user_id: str | None = None, start: Time | None = None, end: Time | None = None) -> DataFrame:
    return select_rows(df, start, end, userId=user_id)


def session_by_id(df: DataFrame, session_id: str) -> DataFrame:
    return newest(select_rows(df, sessionId=session_id))


def session_counts(df: DataFrame, user_id: str | None = None) -> DataFrame:
    return sessions(df, user_id).agg(F.count("*").alias("n"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows of every value of a column, as of sessions by user or events by type."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def counts_by_user(df: DataFrame) -> DataFrame:
    return counts_by(df, "userId")


def long_sessions(df: DataFrame, min_ms: int) -> DataFrame:
    return df.filter(F.col("durationMs") >= min_ms)


def page_metrics(df: DataFrame, page_url: str | None = None, start: Time | None = None, end: Time | None = None) -> DataFrame:
    return select_rows(df, start, end, pageUrl=page_url)


def top_pages(df: DataFrame, start: Time, end: Time, k: int = DEFAULT_TOP, per_page: bool = False) -> DataFrame:
    """Windows with most views in the range; per_page sums a page's windows first. Ties by key."""
    if not 1 <= k <= MAX_SIZE:
        raise ValueError(f"limit must lie in 1 to {MAX_SIZE}")
    rows = in_range(df, start, end)
    if per_page:
        return rows.groupBy("pageUrl").agg(F.sum("totalViews").alias("totalViews")).orderBy(F.desc("totalViews"), "pageUrl").limit(k)
    return rows.orderBy(F.desc("totalViews"), "_compositeKey").limit(k)


def journeys_of_user(df: DataFrame, user_id: str) -> DataFrame:
    return newest(select_rows(df, userId=user_id))


def journey_of_session(df: DataFrame, session_id: str) -> DataFrame:
    return newest(select_rows(df, sessionId=session_id))


def display(df: DataFrame) -> DataFrame:
    """Adds durationText (Xm Ys) to sessions."""
    s = F.floor(F.col("durationMs") / 1000)
    return df.withColumn("durationText", F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def percent(column: str):
    """A share as a percentage with one decimal."""
    return F.concat(F.format_string("%.1f", F.col(column) * 100), F.lit("%"))
