"""The streaming jobs: sessions, page metrics, journeys and the archive over one source, each with its own checkpoint."""

from __future__ import annotations

import datetime
import json
import logging
import math
import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..functions.scrub import scrub
from ..functions.validation import errors
from ..operators.journeys import user_journeys
from ..operators.live import live_panes, series_of, windows_of
from ..operators.pages import closing_bounces, page_metrics
from ..operators.sessions import session_aggregates
from ..sources.events import micros, parse_json, with_event_time, with_watermark
from .sinks import KeyedTable, _Folder, archive_batch, quarantine, undelivered, with_retries
from .stateful import ROCKSDB_SETTINGS, clicks_by_view_stream, keyed_state, last_reports  # noqa: F401

log = logging.getLogger(__name__)


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Streams that are started here keep their state in RocksDB, so that its size isn't bounded by the heap, and in two partitions a core, or in
    spark.sql.shuffle.partitions if those are fewer: every batch opens and commits each of them, so hundreds cost more than the events of most batches. A stream
    keeps what it was first started with."""
    partitions = "spark.sql.shuffle.partitions"
    was = {partitions: spark.conf.get(partitions)} | {name: spark.conf.get(name, None) for name in ROCKSDB_SETTINGS}
    keyed_state(spark)
    spark.conf.set(partitions, str(min(int(was[partitions]), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def _started(writer: DataStreamWriter, spark: SparkSession, every: str | None) -> StreamingQuery:
    """every=None works off what is there and ends."""
    with state_settings(spark):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _start(df: DataFrame, name: str, root: str, mode: str, every: str | None) -> StreamingQuery:
    """Merges a job's output into root/tables/name."""
    return _batches(df, name, root, with_retries(KeyedTable(df.sparkSession, f"{root}/tables/{name}").merge), every, mode)


#: The jobs over valid typed events, with their output mode: event stream, gap, window -> rows by key.
JOBS: dict[str, tuple[Callable[[DataFrame, str, str], DataFrame], str]] = {
    "sessions": (lambda timed, gap, window: session_aggregates(timed, gap), "append"),
    "page-metrics": (lambda timed, gap, window: page_metrics(timed, window, exact=False), "update"),
    "user-journeys": (lambda timed, gap, window: user_journeys(timed, gap), "append"),
    "page-bounces": (closing_bounces, "append"),
}


def start_jobs(events: DataFrame, root: str, gap: str = "30 minutes", window: str = "5 minutes", watermark: str = "10 minutes", every: str | None = "30 seconds", names: Iterable[str] = tuple(JOBS)) -> dict[str, StreamingQuery]:
    """events: a stream of valid typed events. Sessions and journeys appear once the watermark has passed their end, bounce rates once it has passed
    the window in which sessions end; page metrics are updated. names: the jobs to start, which don't need each other."""
    timed = with_watermark(events, watermark)
    return {name: _start(JOBS[name][0](timed, gap, window), name, root, JOBS[name][1], every) for name in names}


def start_live(events: DataFrame, root: str, pane: str = "1 minute", watermark: str = "10 minutes", every: str | None = "5 seconds") -> StreamingQuery:
    """The live metrics kept by a stream: a row of counts and sketches for each pane, merged by pane into root/tables/live-panes, from which
    snapshot_of, trending_of and series_of answer. State is a row a pane, whatever the events, users and pages."""
    return _start(live_panes(with_watermark(events, watermark), pane), "live-panes", root, "update", every)


def start_series(events: DataFrame, root: str, width: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes", every: str | None = "5 seconds") -> StreamingQuery:
    """The live metrics of sliding windows, kept by a stream: panes of what width and slide have in common, as of start_live, and root/tables/live-series, in which a
    batch replaces the windows that hold a pane it changed (users are approximate)."""
    panes, series = KeyedTable(events.sparkSession, f"{root}/tables/live-panes"), KeyedTable(events.sparkSession, f"{root}/tables/live-series")

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            panes.merge(batch, batch_id)
            first, last = batch.agg(F.min("windowStart"), F.max("windowEnd")).first()
            if first is None:
                return
            span = datetime.timedelta(microseconds=micros(width))
            near = series_of(panes.between(first - span, last + span), width, slide).join(windows_of(batch, width, slide), "windowStart", "left_semi")
            series.merge(near.withColumn("_compositeKey", F.col("windowStart").cast("string")), batch_id)
        finally:
            batch.unpersist()

    pane = f"{math.gcd(micros(width), micros(slide))} microseconds"
    return _batches(live_panes(with_watermark(events, watermark), pane), "live-series", root, with_retries(merge), every, "update")


def last_watermark(query: StreamingQuery) -> datetime.datetime | None:
    """The event time up to which a query's results are final."""
    marks = [p.eventTime["watermark"] for p in query.recentProgress if p.eventTime.get("watermark")]
    return datetime.datetime.fromisoformat(marks[-1].replace("Z", "+00:00")) if marks else None


def _batches(df: DataFrame, name: str, root: str, write: Callable[[DataFrame, int], None], every: str | None, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/checkpoints/{name}").foreachBatch(write)
    return _started(writer, df.sparkSession, every)


def start_archive(events: DataFrame, root: str, every: str | None = "60 seconds", write: Callable[[DataFrame, str], None] | None = None, first_ms: int = 100) -> StreamingQuery:
    """Appends every batch to root/lake, each event once even if a batch's commit is lost (with a `write` of one's own it is written again); a batch
    that fails three times goes to root/undelivered, and the stream goes on."""
    lake, failed = f"{root}/lake", f"{root}/undelivered"
    write_batch = with_retries(lambda batch, batch_id: write(batch, lake) if write else archive_batch(batch, batch_id, lake), first_ms=first_ms, failed=lambda batch, batch_id: undelivered(batch, batch_id, lake, failed))
    return _batches(events, "archive", root, write_batch, every)


def checked_values(values: DataFrame, as_of_ms: int | None = None, scrubbing: bool = True, salt: str | None = None) -> DataFrame:
    """JSON values as events with their errors: parsed, scrubbed (with a salt user ids are hashed; events on sensitive elements are dropped and leave no trace), validated.

    Rows come out of a generator, so that a filter on errors stays above it and doesn't scrub and judge every event a second time.
    """
    events = parse_json(values)
    checked = with_event_time(scrub(events, salt) if scrubbing else events).withColumn("errors", errors(as_of_ms))
    return checked.select(F.inline(F.array(F.struct(*checked.columns))))


def start_intake(values: DataFrame, root: str, every: str | None = "30 seconds", as_of_ms: int | None = None, scrubbing: bool = True, salt: str | None = None) -> StreamingQuery:
    """Parses, scrubs and validates JSON values, once for all jobs that follow, into root/checked: valid events (folder valid=true) apart from the others,
    which have their errors. Spark's own file sink logs the files of a batch, so that streams over them meet each event once."""
    checked = checked_values(values, as_of_ms, scrubbing, salt).withColumn("valid", F.size("errors") == 0)
    writer = checked.writeStream.queryName("intake").outputMode("append").format("parquet").partitionBy("valid").option("path", f"{root}/checked").option("checkpointLocation", f"{root}/checkpoints/intake")
    return _started(writer, values.sparkSession, every)


def checked_stream(spark: SparkSession, root: str, valid: bool) -> DataFrame:
    """What an intake has written to root/checked, and will write: the valid events, or the others with their errors. Only their own folder is read."""
    _Folder(spark, root).make("checked")
    schema = checked_values(spark.createDataFrame([], "value string")).schema.add("valid", "boolean")
    return spark.readStream.schema(schema).parquet(f"{root}/checked").filter(F.col("valid") == valid).drop(*["valid", "errors"][: 1 + valid])


def start_pipeline(
    values: DataFrame, root: str, gap: str = "30 minutes", window: str = "5 minutes", watermark: str = "10 minutes", every: str | None = "30 seconds", as_of_ms: int | None = None, pane: str = "1 minute", scrubbing: bool = True, salt: str | None = None
) -> dict[str, StreamingQuery]:
    """The whole job over a stream of JSON values: parse, scrub, validate (the intake), then jobs, live panes and archive over valid events, the others to
    root/quarantine with their errors. With every=None the intake has worked off what is there before the others start.

    Every query reads by itself, with offsets and checkpoint of its own, so one may fall behind or fail without the others: the intake reads the source,
    the others what it has written, which stays in root/checked until it is cleared.
    """
    spark = values.sparkSession
    queries = {"intake": start_intake(values, root, every, as_of_ms, scrubbing, salt)}
    if every is None:
        queries["intake"].awaitTermination()
    _Folder(spark, root).make("quarantine")  # found also while nothing is rejected
    good = checked_stream(spark, root, True)
    queries |= start_jobs(good, root, gap, window, watermark, every)
    queries["live-panes"] = start_live(good, root, pane, watermark, every)
    queries["archive"] = start_archive(good, root, every)
    queries["quarantine"] = _batches(checked_stream(spark, root, False), "quarantine", root, with_retries(lambda b, i: quarantine(b, i, f"{root}/quarantine")), every)
    return queries


def run_until_stopped(spark: SparkSession, queries: dict[str, StreamingQuery]) -> None:
    """Waits for any query to end, then stops all."""
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for q in queries.values():
            q.stop()


class ProgressListener(StreamingQueryListener):
    """Keeps the last progress reports and, of those before them, one row of totals for each query; logs every tenth, and warns when a query falls
    behind its input. Memory is bounded by `keep` and the number of queries, and totals stay right however long the jobs run."""

    def __init__(self, every: int = 10, behind: float = 1.5, keep: int = 10_000):
        self.rows: deque[dict] = deque(maxlen=keep)
        self.totals: dict[str, dict] = {}
        self.failures: deque[dict] = deque(maxlen=keep)
        self._unsaved: dict[str, dict] = {}
        self._every, self._behind, self._lock = every, behind, threading.Lock()

    def onQueryStarted(self, event) -> None:
        log.info("started %s", event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"name": p.name, "runId": str(p.runId), "batchId": p.batchId, "timestamp": p.timestamp, "rows": p.numInputRows, "inputRate": p.inputRowsPerSecond, "processedRate": p.processedRowsPerSecond, "durationMs": dict(p.durationMs).get("triggerExecution", 0)}
        row["late"] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        row["lag"] = max((int(dict(s.metrics or {}).get("maxOffsetsBehindLatest", 0)) for s in p.sources), default=0)
        row["reports"] = 1
        with self._lock:
            if len(self.rows) == self.rows.maxlen:
                oldest = self.rows.popleft()
                self.totals[oldest["name"]] = _added(self.totals.get(oldest["name"]), oldest)
            self.rows.append(row)
            self._unsaved[p.name] = _added(self._unsaved.get(p.name), row)
        if p.batchId % self._every == 0:
            log.info("%s", json.dumps(row))
        if row["processedRate"] and row["inputRate"] > self._behind * row["processedRate"]:
            log.warning("%s takes %.0f rows/s and gets %.0f", p.name, row["processedRate"], row["inputRate"])

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.failures.extend([{"runId": str(event.runId), "exception": event.exception}] if event.exception else [])
        (log.error if event.exception else log.info)("ended %s: %s", event.runId, event.exception)

    def reports(self) -> list[dict]:
        """What is kept: totals of the older reports and the last ones."""
        with self._lock:
            return [*self.totals.values(), *self.rows]

    def unsaved(self) -> list[dict]:
        """Totals for each query since this was last asked."""
        with self._lock:
            out, self._unsaved = list(self._unsaved.values()), {}
        return out


def _added(total: dict | None, row: dict) -> dict:
    """A query's totals and its next report as one row: sums of rows, late rows and reports, the greatest lag, the last of all else."""
    if total is None:
        return row
    return row | {c: total[c] + row[c] for c in ("rows", "late", "reports", "durationMs")} | {"lag": max(total["lag"], row["lag"])}


PROGRESS = "name string, runId string, batchId long, timestamp string, rows long, inputRate double, processedRate double, durationMs long, late long, lag long"


def _progress(spark: SparkSession, rows: list[dict]) -> DataFrame:
    schema = f"{PROGRESS}, reports long"
    return spark.createDataFrame([[r[f.split()[0]] for f in schema.split(", ")] for r in rows], schema)


def job_progress(spark: SparkSession, listener: ProgressListener) -> DataFrame:
    """All progress of this application: the last reports one by one, those before them as a row for each query."""
    return _progress(spark, listener.reports())


def save_progress(spark: SparkSession, listener: ProgressListener, path: str) -> None:
    """Appends what was reported since the last call, a row for each query, so that counters over the table hold what all applications did."""
    if rows := listener.unsaved():
        _progress(spark, rows).coalesce(1).write.mode("append").parquet(path)


def counters(progress: DataFrame) -> DataFrame:
    """Rows, batches and last write of each job. A row of progress stands for one report, or for as many as its column reports says."""
    batches = F.sum("reports") if "reports" in progress.columns else F.count("*")
    return progress.groupBy("name").agg(F.sum("rows").alias("processed"), batches.alias("batches"), F.max(F.to_timestamp("timestamp")).alias("lastWrite"), F.sum("late").alias("late"), F.max("lag").alias("maxLag"))


def stalled(progress: DataFrame, as_of, interval_seconds: int, failures: int = 0, max_failures: int = 3) -> DataFrame:
    """Jobs without a write for max(2 minutes, 3 intervals), or all if there were max_failures or more."""
    silent = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("lastWrite")
    return counters(progress).withColumn("silentSeconds", silent).filter(F.lit(failures >= max_failures) | (silent > max(120, 3 * interval_seconds)))


def over_lag(progress: DataFrame, limit: int = 1000) -> DataFrame:
    return counters(progress).filter(F.col("maxLag") > limit)
