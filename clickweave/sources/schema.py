"""The event schema: one union of what producers send and what readers expect."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TYPES = ("CLICK", "PAGE_VIEW", "SCROLL", "HOVER")

METADATA = T.StructType(
    [
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("scrollDepth", T.DoubleType()),
        T.StructField("viewportWidth", T.IntegerType()),
        T.StructField("viewportHeight", T.IntegerType()),
        T.StructField("elementText", T.StringType()),
        T.StructField("durationMs", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("deviceType", T.StringType()),
        T.StructField("screenResolution", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("eventId", T.StringType()),
        T.StructField("userId", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("targetElement", T.StringType()),
        T.StructField("pageUrl", T.StringType()),
        T.StructField("referrerUrl", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("schemaVersion", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)
