"""Validation rules as one array of messages per event; no rule needs a UDF or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import EVENT_TYPES

#: The patterns and limits of the rules.
XSS = r"(?i)<script|javascript:|onerror=|onclick=|<iframe"
PII = r"(?i)\b(password|passwd|pwd|ssn|social.?security|credit.?card|cvv|pin)\b"
IPV4 = r"(?<!/)\b(?:\d{1,3}\.){3}\d{1,3}\b"
MAX_LENGTH = {"eventId": 255, "userId": 255, "sessionId": 255, "pageUrl": 2048, "referrerUrl": 2048, "targetElement": 512, "userAgent": 8192, "metadata.elementText": 1024}
FUTURE_MS, PAST_MS = 5 * 60 * 1000, 24 * 60 * 60 * 1000
MAX_BATCH = 100


def blank(column: str) -> Column:
    """Null, or nothing but white space of any kind."""
    return ~F.coalesce(F.col(column).rlike(r"\P{javaWhitespace}"), F.lit(False))


def url_error(column: str) -> Column:
    """A message, or null: not parseable, no scheme, or another scheme than http and https, which are written in lower case."""
    scheme = F.try_parse_url(F.col(column), F.lit("PROTOCOL"))
    return (
        F.when(scheme.isin("http", "https"), None)
        .when(scheme.isNotNull(), f"{column} must use http or https")
        .when(F.try_parse_url(F.col(column), F.lit("PATH")).isNull(), f"{column} is not a valid URL")
        .otherwise(f"{column} has no scheme")
    )


def errors(as_of_ms: Column | int | None = None) -> Column:
    """All failures of an event (columns of the event schema), in rule order. as_of_ms: the present, in epoch milliseconds; now by default."""
    now = F.unix_millis(F.current_timestamp()) if as_of_ms is None else as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    ts, kind = F.col("timestamp"), F.col("eventType")
    rules: list[Column] = [F.when(blank(c), f"{c} is required") for c in ("eventId", "userId", "sessionId")]
    rules.append(F.when(kind.isNull(), "eventType is required").when(~kind.isin(*EVENT_TYPES), "eventType is unknown"))
    rules.append(F.when(blank("pageUrl"), "pageUrl is required"))
    rules.append(F.when(ts.isNull(), "timestamp is required"))
    rules += [F.when(F.length(c) > n, f"{c.rpartition('.')[2]} is longer than {n}") for c, n in MAX_LENGTH.items()]
    rules.append(F.when(ts <= 0, "timestamp must be positive").when(ts > now + FUTURE_MS, "timestamp is in the future").when(ts < now - PAST_MS, "timestamp is too old"))
    rules += [F.when(~blank(c), url_error(c)) for c in ("pageUrl", "referrerUrl")]
    rules += [F.when(F.col(c).rlike(XSS), f"{c.rpartition('.')[2]} holds markup or script") for c in ("targetElement", "pageUrl", "metadata.elementText")]
    rules.append(F.when(F.col("sessionId") == F.col("userId"), "sessionId equals userId"))
    rules.append(F.when(F.col("metadata.elementText").rlike(PII), "elementText names personal data"))
    rules.append(F.when(F.col("userAgent").rlike(IPV4), "userAgent holds an IP address"))
    meta = F.col("metadata").isNotNull()
    rules.append(F.when((kind == "CLICK") & blank("targetElement"), "CLICK needs targetElement"))
    rules.append(F.when((kind == "CLICK") & meta & (F.col("metadata.x").isNull() | F.col("metadata.y").isNull()), "CLICK needs x and y"))
    depth = F.col("metadata.scrollDepth")
    rules.append(F.when((kind == "SCROLL") & depth.isNull(), "SCROLL needs scrollDepth").when((kind == "SCROLL") & ~depth.between(0, 1), "scrollDepth must lie in 0 to 1"))
    rules.append(F.when((kind == "HOVER") & blank("targetElement"), "HOVER needs targetElement"))
    rules.append(F.when((kind == "HOVER") & F.col("metadata.durationMs").isNull(), "HOVER needs durationMs"))
    return F.array_compact(F.array(*rules))


def validate(events: DataFrame, as_of_ms: Column | int | None = None) -> DataFrame:
    """Adds errors (array of messages)."""
    return events.withColumn("errors", errors(as_of_ms))


def split_valid(events: DataFrame, as_of_ms: Column | int | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid events without the column errors, and the others with it."""
    checked = validate(events, as_of_ms)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def reason_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def acceptance_rate(checked: DataFrame) -> DataFrame:
    ok = F.when(F.size("errors") == 0, 1.0).otherwise(0.0)
    return checked.agg(F.count("*").alias("n"), F.sum(ok).cast("long").alias("accepted"), F.avg(ok).alias("rate"))


def has_keys() -> Column:
    """The archive's quick check."""
    return F.col("eventId").isNotNull() & F.col("sessionId").isNotNull()


def judge_batches(checked: DataFrame, max_batch: int = MAX_BATCH) -> DataFrame:
    """batch_id, n, first_invalid (index or null), accepted: a batch is taken whole or not at all. checked: batch_id, index, errors."""
    bad = F.min(F.when(F.size("errors") > 0, F.col("index"))).alias("first_invalid")
    batches = checked.groupBy("batch_id").agg(F.count("*").alias("n"), bad)
    return batches.withColumn("accepted", F.col("first_invalid").isNull() & (F.col("n") <= max_batch))
