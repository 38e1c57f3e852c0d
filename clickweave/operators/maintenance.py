"""Table maintenance and audits."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validation import validate
from ..sources.events import interval

PARTITIONS = ("year", "month", "day", "hour")


def expire(df: DataFrame, as_of: datetime.datetime | str, days: int = 30, column: str = "windowStart") -> DataFrame:
    """Rows that are not older than `days` at as_of."""
    return df.filter(F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def partition_predicate(start: datetime.datetime, end: datetime.datetime) -> Column:
    """The lake's date partitions that meet [start, end] (UTC): a filter that prunes folders, beside the one on ts."""
    number = F.col("year").cast("int") * 1000000 + F.col("month").cast("int") * 10000 + F.col("day").cast("int") * 100 + F.col("hour").cast("int")
    at = lambda t: t.year * 1000000 + t.month * 10000 + t.day * 100 + t.hour
    return number.between(at(start), at(end))


def _folders(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the innermost partition folders below it, as (folder, {column: value})."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def walk(folder, values):
        below = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
        if not below:
            yield folder, values
        for p in below:
            name, _, value = p.getName().partition("=")
            yield from walk(p, values | {name: value})

    return fs, list(walk(root, {})) if fs.exists(root) else []


def drop_before(spark: SparkSession, path: str, cutoff: datetime.datetime) -> int:
    """Deletes the lake's hour folders before cutoff (UTC); returns how many. Only folder names are read."""
    fs, folders = _folders(spark, path)
    old = [f for f, v in folders if v and tuple(int(v[c]) for c in PARTITIONS) < (cutoff.year, cutoff.month, cutoff.day, cutoff.hour)]
    for f in old:
        fs.delete(f, True)
    return len(old)


def compact(spark: SparkSession, path: str, target: str, file_rows: int = 250_000) -> DataFrame:
    """Rewrites a partitioned table with few files a partition; fails if a row is lost. Returns the new table.

    Rows of a folder are brought together by a rebalancing shuffle, which adaptive execution splits where one folder holds much.
    """
    table = spark.read.parquet(path)
    by = [c for c in PARTITIONS if c in table.columns]
    table.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(*by).parquet(target)
    compacted = spark.read.parquet(target)
    if (was := table.count()) != (now := compacted.count()):
        raise RuntimeError(f"{was} rows before compaction, {now} after")
    return compacted


def write_for_lookup(df: DataFrame, path: str, key: str) -> None:
    """Date folders, rows sorted by key and time within them, so that file statistics skip what a lookup doesn't need."""
    dated = df.withColumn("date", F.to_date("windowStart"))
    dated.repartitionByRange("date", key).sortWithinPartitions("date", key, F.desc("windowStart")).write.mode("overwrite").partitionBy("date").parquet(path)


def rate_violations(events: DataFrame, limit: int = 1000, width: str = "1 second", key: str = "userId") -> DataFrame:
    """Keys with more than `limit` events in a window."""
    counts = events.groupBy(key, F.window("ts", interval(width)).alias("window")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select(key, F.col("window.start").alias("windowStart"), "n")


def bucket(key: str, partitions: int) -> Column:
    """A partition number from a key's hash, the same in other engines."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long") % partitions).cast("int")


def key_skew(events: DataFrame, key: str, partitions: int = 6) -> DataFrame:
    """partition, n, share of the mean (1 is even) if events were dealt by this key."""
    counts = events.groupBy(bucket(key, partitions).alias("partition")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("partition", "n", (F.col("n") * partitions / F.col("total")).alias("skew"))


#: Ids that one broadcast may hold.
MAX_BROADCAST_ROWS = 1_000_000


def hours_of(events: DataFrame, archive: DataFrame, most: int = 1000) -> DataFrame:
    """The part of a lake that can hold these events: events are filed under their own hour, so only their hours' folders are read (beyond `most` hours all from
    the first to the last)."""
    if not set(PARTITIONS) <= set(archive.columns):
        return archive
    number = F.date_format("ts", "yyyyMMddHH").cast("int")
    hours = sorted(r[0] for r in events.filter(F.col("ts").isNotNull()).select(number).distinct().limit(most + 1).collect())
    at = sum((F.col(c).cast("int") * factor for c, factor in zip(PARTITIONS, (1_000_000, 10_000, 100, 1), strict=True)), F.lit(0))
    if len(hours) > most:
        first, last = events.agg(F.min(number), F.max(number)).first()
        return archive.filter(at.between(first, last))
    return archive.filter(at.isin(hours) if hours else F.lit(False))


def reingest(quarantine: DataFrame, archive: DataFrame, as_of_ms: int) -> DataFrame:
    """Quarantined events that are valid by now, once each, and that the archive doesn't hold yet.

    Of a lake only the hours of these events are read, and of them only ids are kept that are asked for, where they are read; beyond MAX_BROADCAST_ROWS
    events ids are shuffled instead.
    """
    again = validate(quarantine.drop("errors", "batch_id"), as_of_ms).filter(F.size("errors") == 0).drop("errors").dropDuplicates(["eventId"])
    held = hours_of(again, archive).select("eventId")
    if again.count() <= MAX_BROADCAST_ROWS:
        held = held.join(F.broadcast(again.select("eventId")), "eventId", "left_semi")
    return again.join(held, "eventId", "left_anti")
