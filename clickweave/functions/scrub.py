"""Privacy projections as column expressions, and the two that need an order of events (debounce, session ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that mark sensitive elements.
SENSITIVE = ("password", "creditCard", "ssn", "secret")
SESSION_GAP_MS = 30 * 60 * 1000
DEBOUNCE_MS = 200


def anonymize_ip(ip: Column) -> Column:
    """IPv4: the last part becomes 0, anything else than four parts 0.0.0.0. IPv6: three groups and ::, fewer than three give ::."""
    text = F.coalesce(F.trim(ip), F.lit(""))
    four, six = F.split(text, r"\.", -1), F.split(text, ":", -1)
    v4 = F.when(F.size(four) == 4, F.concat(F.array_join(F.slice(four, 1, 3), "."), F.lit(".0"))).otherwise("0.0.0.0")
    v6 = F.when(F.size(six) >= 3, F.concat(F.array_join(F.slice(six, 1, 3), ":"), F.lit("::"))).otherwise("::")
    return F.when(text == "", "0.0.0.0").when(text.contains(":"), v6).otherwise(v4)


def mask_id(value: Column) -> Column:
    return F.when(F.coalesce(F.length(value), F.lit(0)) <= 4, "***").otherwise(F.concat(F.substring(value, 1, 4), F.lit("***")))


def hash_id(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value), 256)


def strip_markup(value: Column, length: int = 200) -> Column:
    return F.substring(F.regexp_replace(value, "<[^>]*>", ""), 1, length)


def is_sensitive(value: Column) -> Column:
    """Any sensitive word, in either case."""
    return F.coalesce(F.lower(value).rlike("|".join(w.lower() for w in SENSITIVE)), F.lit(False))


def sanitize_url(url: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?is)<script[^>]*>.*?</script>", ""), r"(?i)javascript:", ""), r"(?i)on\w+=", "")
    return F.when(url.rlike("^https?://"), safe).otherwise(F.regexp_replace(url, "[<>'\"]", ""))


def http_only(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url)


def clamp_depth(depth: Column) -> Column:
    return F.when(depth.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), depth)))


def scrub(events: DataFrame, salt: str | None = None) -> DataFrame:
    """Drops events on sensitive elements and cleans the rest in one projection; with a salt, user ids are hashed."""
    df = events.filter(~is_sensitive(F.col("targetElement")))
    df = df.withColumns({"targetElement": strip_markup(F.col("targetElement")), "pageUrl": sanitize_url(F.col("pageUrl")), "referrerUrl": http_only(F.col("referrerUrl"))})
    df = df.withColumn("metadata", F.col("metadata").withField("scrollDepth", clamp_depth(F.col("metadata.scrollDepth"))))
    return df.withColumn("userId", hash_id(F.col("userId"), salt)) if salt else df


def debounce(events: DataFrame, keys: tuple[str, ...] = ("userId", "sessionId", "targetElement"), gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Of clicks that follow each other within gap_ms on one component only the last stays; other events stay."""
    after = F.lead("timestamp").over(Window.partitionBy(*keys, "eventType").orderBy("timestamp", "eventId"))
    return events.withColumn("_next", after).filter((F.col("eventType") != "CLICK") | F.col("_next").isNull() | (F.col("_next") - F.col("timestamp") >= gap_ms)).drop("_next")


def assign_sessions(events: DataFrame, gap_ms: int = SESSION_GAP_MS, column: str = "sessionId") -> DataFrame:
    """Session ids userId-n: a new one after gap_ms or more without an event of the user."""
    order = Window.partitionBy("userId").orderBy("timestamp", "eventId")
    starts = F.coalesce((F.col("timestamp") - F.lag("timestamp").over(order) >= gap_ms).cast("int"), F.lit(1))
    df = events.withColumn("_starts", starts)
    number = F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(column, F.concat_ws("-", "userId", number.cast("string"))).drop("_starts")


def deduplicate(events: DataFrame, key: str = "eventId") -> DataFrame:
    """One row of each key; a stream keeps keys for the watermark's delay."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
