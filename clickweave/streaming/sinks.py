"""Sinks: publishing, the raw archive, keyed idempotent merges, quarantine and Arrow export."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.validation import split_valid
from ..operators.maintenance import PARTITIONS, write_for_lookup
from ..sources.schema import EVENT


def event_json() -> Column:
    """An event as JSON, without null fields."""
    return F.to_json(F.struct(*(c for c in EVENT.fieldNames())))


def keyed_json(events: DataFrame) -> DataFrame:
    """key (the session) and value (the event as JSON, without null fields), as message queues take them."""
    return events.select(F.col("sessionId").alias("key"), event_json().alias("value"))


def publish(events: DataFrame, servers: str, topic: str) -> None:
    keyed_json(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def with_partitions(events: DataFrame) -> DataFrame:
    """Adds year, month, day, hour of each row's own ts (UTC session), zero-padded."""
    forms = dict(zip(PARTITIONS, ("yyyy", "MM", "dd", "HH"), strict=True))
    return events.withColumns({c: F.date_format("ts", f) for c, f in forms.items()})


ARCHIVE_OPTIONS = {"compression": "snappy", "maxRecordsPerFile": "10000", "parquet.block.size": str(128 << 20), "parquet.page.size": str(1 << 20)}


def archive(events: DataFrame, path: str) -> None:
    """Appends a batch to the lake. Rows of a folder are brought together first, so that each gets few files; adaptive execution splits a hot hour."""
    with_partitions(events).hint("rebalance", *PARTITIONS).write.mode("append").options(**ARCHIVE_OPTIONS).partitionBy(*PARTITIONS).parquet(path)


def archive_stream(events: DataFrame, path: str, checkpoint: str, every: str = "60 seconds") -> DataStreamWriter:
    writer = with_partitions(events).writeStream.format("parquet").outputMode("append").options(**ARCHIVE_OPTIONS)
    return writer.partitionBy(*PARTITIONS).option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every)


class _Folder:
    """A folder on whatever file system Hadoop knows, by paths below it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _list(self, path: str) -> list[str]:
        fs, at = self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def make(self, path: str) -> None:
        fs, at = self._path(path)
        fs.mkdirs(at)

    def _delete(self, path: str) -> None:
        fs, at = self._path(path)
        fs.delete(at, True)

    def _rename(self, source: str, target: str) -> None:
        fs, at = self._path(target)
        fs.delete(at, True)  # of an attempt that broke off
        fs.mkdirs(at.getParent())
        if not fs.rename(self._path(source)[1], at):
            raise OSError(f"{source} wasn't moved to {target}")

    def last_mark(self, folder: str) -> int:
        return max(map(int, self._list(folder)), default=-1)

    def mark(self, folder: str, batch_id: int) -> None:
        """A batch counts once its mark is there; marks before the last but one go."""
        fs, at = self._path(f"{folder}/{batch_id}")
        fs.create(at, True).close()
        for old in self._list(folder):
            if int(old) < batch_id - 1:
                self._delete(f"{folder}/{old}")


def query_id(df: DataFrame) -> str:
    """Of the streaming query whose batch this is: it stays over restarts from one checkpoint and differs for another."""
    return (df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none").split("-")[0]


def archive_batch(events: DataFrame, batch_id: int, path: str) -> None:
    """Appends a numbered batch to the lake, once: in each hour its rows have a folder of their own, named by the query and the batch. A mark says which batch was
    begun last; one that comes again, wherever it broke off before, first takes out what it left. Queries with checkpoints of their own may share a lake."""
    lake, query = _Folder(events.sparkSession, path), query_id(events)
    if lake.last_mark(f"_begun/{query}") >= batch_id:
        _take_out(lake, f"{query}-{batch_id}")
    lake.mark(f"_begun/{query}", batch_id)
    rows = with_partitions(events).withColumn("batch", F.lit(f"{query}-{batch_id}")).hint("rebalance", *PARTITIONS)
    rows.write.mode("append").options(**ARCHIVE_OPTIONS).partitionBy(*PARTITIONS, "batch").parquet(path)


def _take_out(lake: _Folder, batch: str) -> None:
    fs, hours = lake._path("/".join(f"{c}=*" for c in PARTITIONS) + f"/batch={batch}")
    for left in fs.globStatus(hours) or []:
        fs.delete(left.getPath(), True)


def undelivered(events: DataFrame, batch_id: int, path: str, kept: str) -> None:
    """Keeps a batch that can't be archived, whole, in a folder of its own, and leaves none of its rows in the lake."""
    quarantine(events, batch_id, kept)
    _take_out(_Folder(events.sparkSession, path), f"{query_id(events)}-{batch_id}")


class KeyedTable(_Folder):
    """A Parquet table that is merged by key: a batch is appended, and the newest row of each key counts.

    A batch writes its own rows only, as date=D/v=batch for each day D of `by` that it touches, and a marker in _commits makes it
    count. Readers take the rows of committed batches and keep the last of every key, so they never see half a merge; a batch that is
    replayed, after its commit or before it, changes nothing. A day that `fold` batches have touched is folded: its last rows are
    written once as date=D/f=batch, and what is older than the fold before goes. Batches come in order of their numbers. Keys must hold what
    `by` is derived from; for keys that don't, by=None keeps one day for all.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "_compositeKey", latest: str = "windowEnd", by: str | None = "windowStart", fold: int = 20):
        super().__init__(spark, root)
        self.key, self.latest, self.by, self.fold = key, latest, by, fold

    def last_commit(self) -> int:
        return self.last_mark("_commits")

    def parts(self, days: set[str] | None = None) -> dict[str, list[str]]:
        """For each day the folders that count: its newest fold, and the committed batches after it."""
        last, out = self.last_commit(), {}
        for day in self._list("") if days is None else days:
            if day.startswith("date="):
                found = sorted((int(n[2:]), n) for n in self._list(day) if int(n[2:]) <= last)
                folds = [n for n, name in found if name.startswith("f=")]
                out[day] = [name for n, name in found if not folds or n > folds[-1] or name == f"f={folds[-1]}"]
        return {day: names for day, names in out.items() if names}

    def _last_rows(self, parts: dict[str, list[str]]) -> DataFrame | None:
        paths = [f"{self.root}/{day}/{name}" for day, names in parts.items() for name in names]
        if not paths:
            return None
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)
        if all(len(names) == 1 for names in parts.values()):
            return rows
        keyed = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "_batch").alias("_row")).select("_row.*")
        return keyed.unionByName(rows.filter(F.col(self.key).isNull()))

    def read(self, days: set[str] | None = None) -> DataFrame | None:
        """The table, or its days (as date=2024-01-01); None while it is empty."""
        rows = self._last_rows(self.parts(days))
        return rows.drop("_batch") if rows is not None else None

    def between(self, start: datetime.datetime, end: datetime.datetime) -> DataFrame | None:
        """The table's days from that of start to that of end (UTC)."""
        days = (end.date() - start.date()).days + 1
        return self.read({f"date={start.date() + datetime.timedelta(days=k)}" for k in range(days)})

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """Rows replace those of their key; of a batch's rows of one key the latest stays; rows without a key are added."""
        if self.last_commit() >= batch_id:
            return
        keyless = F.col(self.key).isNull()
        # one plan over the batch, for each branch of a union would run its steps with state again; rows without a key are spread by their content
        spread = F.when(keyless, F.xxhash64(F.to_json(F.struct(*rows.columns))))
        order = Window.partitionBy(self.key, "_spread").orderBy(F.desc(self.latest))
        new = rows.withColumn("_spread", spread).withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == 1) | keyless).drop("_n", "_spread")
        new = new.withColumn("updatedAt", F.current_timestamp()).withColumn("_batch", F.lit(batch_id).cast("long"))
        day = F.coalesce(F.date_format(self.by, "yyyy-MM-dd"), F.lit("none")) if self.by else F.lit("all")
        new.withColumn("date", day).hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{self.root}/_staging/{batch_id}")
        days = {d for d in self._list(f"_staging/{batch_id}") if d.startswith("date=")}
        for d in days:
            self._rename(f"_staging/{batch_id}/{d}", f"{d}/v={batch_id}")
        self.mark("_commits", batch_id)
        for d, names in self.parts(days).items():
            if len(names) > self.fold:
                self._fold(d, names, batch_id)
        self._delete("_staging")

    def _fold(self, day: str, names: list[str], batch_id: int) -> None:
        self._last_rows({day: names}).write.mode("overwrite").parquet(f"{self.root}/_staging/fold")
        self._rename("_staging/fold", f"{day}/f={batch_id}")
        before = max((int(n[2:]) for n in names if n.startswith("f=")), default=-1)
        for name in self._list(day):  # readers that began earlier still find what they listed
            if int(name[2:]) < before:
                self._delete(f"{day}/{name}")


def lay_out(table: KeyedTable, path: str, key: str) -> list[str]:
    """Brings a lookup table (date folders, rows sorted by key within them) up to what a job has merged; returns the days rewritten.

    Only days that a batch has touched since the last call are read and written; their number is kept in a mark. Filters of lookups then reach
    the scan, which they can't through a merge by key. Rows without a windowStart are left out. Readers find a day's old rows until its folder is replaced.
    """
    folder = _Folder(table.spark, path)
    now = {day: max(int(n[2:]) for n in names) for day, names in table.parts().items() if day != "date=none"}
    changed = sorted(day for day, n in now.items() if folder.last_mark(f"_days/{day[5:]}") != n)
    if changed:
        write_for_lookup(table.read(set(changed)), f"{path}/_staging", key)
        for day in changed:
            folder._rename(f"_staging/{day}", day)
            folder._delete(f"_days/{day[5:]}")
            folder.mark(f"_days/{day[5:]}", now[day])
        folder._delete("_staging")
    return changed


def with_retries(write: Callable[[DataFrame, int], None], tries: int = 3, first_ms: int = 100, failed: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that tries again after 100, 200, ... ms; after the last try the batch goes to `failed`, or the error on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for n in range(tries):
            try:
                return write(batch, batch_id)
            except Exception:
                if n + 1 < tries:
                    time.sleep(first_ms * 2**n / 1000)
                elif failed is None:
                    raise
        failed(batch, batch_id)

    return run


def quarantine(rejected: DataFrame, batch_id: int, path: str) -> None:
    """Writes rejected events as JSON, each batch in a folder of its own, so that a replayed batch replaces its rows."""
    rejected.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").json(f"{path}/batch={batch_id}")


def route(valid: Callable[[DataFrame, int], None], errors_path: str, as_of_ms: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: valid events go on, the others to quarantine."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split_valid(batch, as_of_ms)
            quarantine(bad, batch_id, errors_path)
            valid(good, batch_id)
        finally:
            batch.unpersist()

    return run


def snapshot_arrow(snapshot: DataFrame, trending: DataFrame) -> tuple[pa.Table, pa.Table]:
    """The one row and the k rows of the live metrics as Arrow tables; k bounds the second."""
    return snapshot.limit(1).toArrow(), trending.toArrow()
