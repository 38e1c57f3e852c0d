"""Event sources and the typed form of events. Every function works on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT


def kafka_events(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options: str) -> DataFrame:
    """Streaming key and value of a Kafka topic (needs Spark's Kafka package on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", starting).option("failOnDataLoss", "false").options(**options).load().selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")


def file_events(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json") -> DataFrame:
    """Events of JSON-lines (or Parquet) files in the event schema."""
    return (spark.readStream if streaming else spark.read).schema(EVENT).format(fmt).load(path)


def parse_json(values: DataFrame, column: str = "value") -> DataFrame:
    """Parses a JSON column and expands it. Text that isn't an event gives a row of nulls, which validation sends to quarantine.

    `referrer` is taken where `referrerUrl` is missing. The text is parsed once a row, whatever is filtered or selected afterwards: the event comes out of a
    generator, below which Spark moves no filter (below a projection it would, with a parse for every column that the filter names).
    """
    alias = F.get_json_object(column, "$.referrer")
    events = F.transform(F.array(F.from_json(F.col(column), EVENT)), lambda e: e.withField("referrerUrl", F.coalesce(e["referrerUrl"], alias)))
    return values.select(F.inline(events))


def parse_json_batches(values: DataFrame, column: str = "value") -> DataFrame:
    """Events of a column of JSON arrays, with batch_id (a hash of the array) and index (from 0)."""
    schema = f"array<{EVENT.simpleString()}>"
    return values.select(F.xxhash64(column).alias("batch_id"), F.posexplode(F.from_json(F.col(column), schema)).alias("index", "event")).select("batch_id", "index", "event.*")


def with_event_time(events: DataFrame, whole_seconds: bool = False) -> DataFrame:
    """Adds ts from epoch milliseconds; whole_seconds drops the milliseconds."""
    ms = F.expr("timestamp - pmod(timestamp, 1000)") if whole_seconds else F.col("timestamp")
    return events.withColumn("ts", F.timestamp_millis(ms))


def with_watermark(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", interval(delay))


def interval(text: str) -> str:
    """Checks that an interval has a number above 0 and a unit: without a unit Spark silently makes empty windows."""
    number, _, unit = text.strip().partition(" ")
    if not number.isdigit() or not unit.strip() or (int(number) == 0):
        raise ValueError(f"interval needs a positive number and a unit, as in '30 minutes': {text!r}")
    return text


#: Microseconds of the units of intervals that have a fixed length.
UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(text: str) -> int:
    """Microseconds of an interval."""
    number, _, unit = interval(text).strip().partition(" ")
    unit = unit.strip().lower().removesuffix("s")
    if unit not in UNITS:
        raise ValueError(f"interval needs a unit of fixed length: {text!r}")
    return int(number) * UNITS[unit]


def table_events(table: DataFrame) -> DataFrame:
    """The test table `events` as typed events (event schema and ts). Its `error` rows keep a type that validation rejects."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kinds = F.create_map(*(F.lit(x) for pair in {"view": "PAGE_VIEW", "click": "CLICK", "purchase": "SCROLL", "signup": "HOVER"}.items() for x in pair))
    ts = F.col("ts").cast("timestamp")
    df = table.select("event_id", "user_id", "event_type", "value", ts.alias("ts"), k.alias("k"))
    metadata = F.struct(
        (F.col("k") * 10).alias("x"),
        (F.col("k") * 5).alias("y"),
        (F.col("k") / 80.0).alias("scrollDepth"),
        F.lit(1920).alias("viewportWidth"),
        F.lit(1080).alias("viewportHeight"),
        F.concat(F.lit("item "), F.col("k")).alias("elementText"),
        F.floor(F.col("value") * 100).cast("long").alias("durationMs"),
        F.lit("1.0").alias("version"),
        F.lit(None).cast("string").alias("deviceType"),
        F.lit(None).cast("string").alias("screenResolution"),
    )
    return df.select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("eventId"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("userId"),
        F.concat(F.lit("sess-"), F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("sessionId"),
        F.coalesce(F.get(F.array(kinds[F.col("event_type")]), 0), F.lit("ERROR")).alias("eventType"),
        F.when(F.col("k") % 11 != 0, F.concat(F.lit("button#b"), F.col("k") % 7)).alias("targetElement"),
        F.concat(F.lit("https://shop.example/p/"), F.col("k") % 20).alias("pageUrl"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("https://ref.example/"), F.col("k") % 5)).alias("referrerUrl"),
        F.unix_millis("ts").alias("timestamp"),
        F.concat(F.lit("Mozilla/5.0 ("), F.when(F.col("user_id") % 2 == 0, "Windows NT 10.0").otherwise("iPhone"), F.lit(") Chrome/120.0.0.0")).alias("userAgent"),
        F.lit("1.0").alias("schemaVersion"),
        metadata.alias("metadata"),
        "ts",
    )
