import datetime as dt

import pytest
from compare import DATA, spark_rows, sql_rows, tables
from events import T0, frame, row
from pyspark.sql import functions as F

from clickweave.functions import validation
from clickweave.operators import journeys, maintenance, pages, sessions
from clickweave.plans import queries
from clickweave.sources import events as sources
from clickweave.sources.schema import EVENT
from clickweave.streaming import jobs, sinks

MIN = 60_000


def write(spark, rows, path):
    sinks.keyed_json(frame(spark, rows)).select("value").coalesce(1).write.mode("append").text(str(path))


def stream(spark, path):
    return sources.with_event_time(sources.file_events(spark, str(path), streaming=True))


def visits(n, start=0, session="s"):
    return [row(f"{session}{start}-{k}", "u", session, "PAGE_VIEW" if k % 2 == 0 else "CLICK", f"/{k % 3}", start + k * MIN, targetElement="b") for k in range(n)]


def run(spark, path, root):
    queries = jobs.start_jobs(stream(spark, path), str(root), every=None)
    for q in queries.values():
        q.awaitTermination()
    return {name: sinks.KeyedTable(spark, f"{root}/tables/{name}").read() for name in queries}


def test_stream_equals_batch_and_restart_keeps_state(spark, tmp_path):
    first, second, closing = visits(5), visits(5, 3 * 60 * MIN), [row("end", "z", "z", "PAGE_VIEW", "/z", 10 * 60 * MIN)]
    write(spark, first, tmp_path / "in")
    run(spark, tmp_path / "in", tmp_path / "out")
    write(spark, second + closing, tmp_path / "in")
    tables = run(spark, tmp_path / "in", tmp_path / "out")
    tables = run(spark, tmp_path / "in", tmp_path / "out")  # nothing new: a replay changes nothing
    batch = frame(spark, first + second)
    key = lambda df, *c: sorted(map(tuple, df.select("_compositeKey", *c).collect()))
    expected = sessions.session_aggregates(batch)
    assert key(tables["sessions"], "pageViewCount", "clickCount", "durationMs") == key(expected, "pageViewCount", "clickCount", "durationMs")
    got = tables["page-metrics"].filter("pageUrl <> '/z'")
    assert key(got, "totalViews", "clickCount") == key(pages.page_metrics(batch), "totalViews", "clickCount")
    assert tables["user-journeys"].count() == 2


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    listener = jobs.ProgressListener()
    spark.streams.addListener(listener)
    try:
        for rows in (visits(1), visits(1, 5 * 60 * MIN, "t"), visits(1, 0, "late"), visits(1, 20 * 60 * MIN, "end")):
            write(spark, rows, tmp_path / "in")
            q = jobs._start(sessions.session_aggregates(sources.with_watermark(stream(spark, tmp_path / "in"))), "sessions", str(tmp_path / "out"), "append", None)
            q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        import time

        time.sleep(1)
        assert sum(r["late"] for r in listener.rows) >= 1  # each stateful step counts it
        got = sinks.KeyedTable(spark, f"{tmp_path}/out/tables/sessions").read()
        assert sorted(r.sessionId for r in got.collect()) == ["s", "t"]
        progress = jobs.job_progress(spark, listener)
        assert jobs.counters(progress).first().processed == 4
        assert jobs.stalled(progress, "2020-01-01 00:00:00", 60).count() == 0
        assert jobs.stalled(progress, "2200-01-01 00:00:00", 60).count() == 1
        assert jobs.over_lag(progress).count() == 0
    finally:
        spark.streams.removeListener(listener)


def test_streamed_clicks_by_view(spark, tmp_path):
    rows = [row("a", "u", "s", "PAGE_VIEW", "/h", 0), row("b", "u", "s", "CLICK", "/h", 1000), row("c", "u", "s", "PAGE_VIEW", "/p", 5000), row("d", "u", "s", "CLICK", "/p", 6000), row("e", "u", "s", "CLICK", "/p", 7000), row("f", "u", "s", "CLICK", "/h", 8000)]
    write(spark, rows, tmp_path / "in")
    write(spark, [row("x", "z", "z", "PAGE_VIEW", "/z", 24 * 60 * MIN)], tmp_path / "in")

    def go():
        q = jobs.clicks_by_view_stream(stream(spark, tmp_path / "in")).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    write(spark, [row("y", "z", "z2", "PAGE_VIEW", "/z", 48 * 60 * MIN)], tmp_path / "in")
    go()
    got = {r.eventId: r.clicksOnPage for r in spark.read.parquet(f"{tmp_path}/out").filter("sessionId = 's'").collect()}
    assert got == {"a": 1, "c": 2}


def click_batches(spark, tmp_path, batches, **options):
    """Runs the click stream with one file a micro-batch; all rows that it reports."""
    for rows in batches:
        write(spark, rows, tmp_path / "in")
        q = jobs.clicks_by_view_stream(stream(spark, tmp_path / "in"), **options).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def counted(df):
    return sorted((r.sessionId, r.eventId, r.pageUrl, r.ts, r.clicksOnPage) for r in df.collect())


def test_clicks_that_come_out_of_order_in_later_batches(spark, tmp_path):
    one = lambda name, kind, page, at: row(name, "u", "s", kind, page, at * MIN)
    batches = [
        [one("a", "PAGE_VIEW", "/h", 0), one("c", "PAGE_VIEW", "/h", 4), one("d", "CLICK", "/h", 5), one("g", "CLICK", "/p", 7)],
        [one("b", "CLICK", "/h", 1), one("h", "PAGE_VIEW", "/q", 8)],  # a click older than the open view
        [one("f", "PAGE_VIEW", "/p", 6), one("i", "CLICK", "/h", 3), one("j", "CLICK", "/q", 9)],  # a view older than the open one and its click
        [one("k", "PAGE_VIEW", "/h", 30), one("l", "CLICK", "/q", 25)],
        [one("m", "CLICK", "/h", 31), row("x", "z", "z", "PAGE_VIEW", "/z", 300 * MIN)],
    ]
    got = click_batches(spark, tmp_path, batches).filter("sessionId = 's'")
    expected = counted(journeys.clicks_by_view(frame(spark, sum(batches, [])).filter("sessionId = 's'")))
    assert counted(got) == expected  # each view once
    assert got.filter("NOT settled").count() == 0


def test_a_click_after_a_silence_reports_its_view_again(spark, tmp_path):
    one = lambda name, kind, at: row(name, "u", "s", kind, "/h", at * MIN)
    other = lambda at: row(f"x{at}", "z", f"z{at}", "PAGE_VIEW", "/z", at * MIN)
    batches = [[one("a", "PAGE_VIEW", 0), one("b", "CLICK", 1), other(60)], [one("c", "CLICK", 100)], [other(200)], [other(4000)]]
    got = click_batches(spark, tmp_path, batches).filter("sessionId = 's'")
    assert sorted(r.clicksOnPage for r in got.collect()) == [1, 2]
    assert [r.clicksOnPage for r in jobs.last_reports(got).collect()] == [2]


def test_click_stream_over_several_files_equals_its_sql(spark, tmp_path):
    events = queries.all_events(spark, f"{DATA}/sf0.001").filter("eventType <> 'ERROR'")
    order = F.unix_millis("ts") + F.pmod(F.xxhash64("eventId"), F.lit(9 * MIN))  # up to nine minutes late
    rows = [r.asDict(recursive=True) for r in events.orderBy(order).drop("ts").collect()]
    for k in range(0, len(rows), 200):
        sinks.keyed_json(sources.with_event_time(spark.createDataFrame(rows[k : k + 200], EVENT))).select("value").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    files = spark.readStream.option("maxFilesPerTrigger", 1).format("text").load(str(tmp_path / "in"))
    out = jobs.clicks_by_view_stream(sources.with_event_time(sources.parse_json(files)), early=True).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
    q = out.trigger(availableNow=True).start()
    q.awaitTermination()
    assert len({p.batchId for p in q.recentProgress}) > 4
    columns = ["eventId", "sessionId", "pageUrl", "clicksOnPage"]
    got = jobs.last_reports(spark.read.parquet(f"{tmp_path}/out")).select(*columns)
    assert spark_rows(got, columns) == sql_rows(tables(f"{DATA}/sf0.001"), queries.SQL["s_stream_clicks"], columns)


@pytest.mark.parametrize("by", [None, "windowStart"])
def test_keyed_merge(spark, tmp_path, by):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), by=by)
    day = lambda d: dt.datetime(2024, 1, d)

    def df(*rows):
        return spark.createDataFrame([(k, day(s), day(e), n) for k, s, e, n in rows], "_compositeKey string, windowStart timestamp, windowEnd timestamp, n int")

    assert table.read() is None
    table.merge(df(("a", 1, 1, 1), ("a", 1, 2, 2), ("b", 1, 1, 3), (None, 3, 3, 9)), 0)
    table.merge(df(("a", 1, 1, 4), ("c", 2, 2, 5), (None, 3, 3, 9)), 1)
    table.merge(df(("a", 1, 1, 99)), 1)  # the same batch again
    got = table.read().collect()
    assert sorted((str(r._compositeKey), r.n) for r in got) == [("None", 9), ("None", 9), ("a", 4), ("b", 3), ("c", 5)]
    assert all(r.updatedAt for r in got)
    table.merge(df(("d", 2, 2, 6)), 2)
    table.merge(df(), 3)
    assert table.last_commit() == 3
    assert table.parts() == ({"date=all": ["v=0", "v=1", "v=2"]} if by is None else {"date=2024-01-01": ["v=0", "v=1"], "date=2024-01-02": ["v=1", "v=2"], "date=2024-01-03": ["v=0", "v=1"]})
    assert table.read().count() == 6


def test_a_batch_writes_its_own_rows_and_days_are_folded(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), fold=3)
    day = lambda k: dt.datetime(2024, 1, 1 + k % 2)

    def df(batch, keys):
        return spark.createDataFrame([(f"k{k}", day(k), day(k), batch) for k in keys], "_compositeKey string, windowStart timestamp, windowEnd timestamp, n int")

    files = lambda: {f.relative_to(tmp_path) for f in tmp_path.glob("t/date=*/*/*.parquet")}
    table.merge(df(0, range(50)), 0)
    before = files()
    table.merge(df(1, [4]), 1)
    new = files() - before
    assert before <= files()
    assert {f.parts[1:3] for f in new} == {("date=2024-01-01", "v=1")}  # one key: no other row is written again
    assert spark.read.parquet(*[str(tmp_path / f) for f in new]).count() == 1
    for batch in range(2, 12):
        table.merge(df(batch, [4, batch + 50]), batch)
    assert table.parts()["date=2024-01-02"][0].startswith("f=")
    assert all(len(names) <= 4 for names in table.parts().values())
    assert len(list((tmp_path / "t" / "date=2024-01-01").iterdir())) <= 9
    assert len([f for f in (tmp_path / "t" / "_commits").iterdir() if not f.name.startswith(".")]) <= 2
    got = {r._compositeKey: r.n for r in table.read().collect()}
    assert got == {f"k{k}": 0 for k in range(50)} | {f"k{k}": k - 50 for k in range(52, 62)} | {"k4": 11}
    assert {r._compositeKey for r in table.read({"date=2024-01-02"}).collect()} == {k for k in got if int(k[1:]) % 2}


def test_a_merge_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"))
    day = dt.datetime(2024, 1, 1)
    df = lambda n: spark.createDataFrame([("a", day, day, n), ("b", day, day, n)], "_compositeKey string, windowStart timestamp, windowEnd timestamp, n int")
    table.merge(df(1), 0)
    whole = sinks.KeyedTable._path

    def broken(self, path):
        if path.startswith("_commits/1"):
            raise RuntimeError("lost")
        return whole(self, path)

    monkeypatch.setattr(sinks.KeyedTable, "_path", broken)
    with pytest.raises(RuntimeError):
        table.merge(df(2), 1)
    monkeypatch.setattr(sinks.KeyedTable, "_path", whole)
    assert {r.n for r in table.read().collect()} == {1}  # not committed, not seen
    table.merge(df(3), 1)
    assert sorted((r._compositeKey, r.n) for r in table.read().collect()) == [("a", 3), ("b", 3)]


def test_retries_and_routing(spark, tmp_path):
    calls = []

    def broken(batch, batch_id):
        calls.append(batch_id)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.with_retries(broken, first_ms=1)(None, 7)
    assert calls == [7, 7, 7]
    failed = []
    sinks.with_retries(broken, first_ms=1, failed=lambda b, i: failed.append(i))(None, 8)
    assert failed == [8]
    kept = []
    df = frame(spark, [row("a", "u", "s", "PAGE_VIEW", "https://e.com/"), row("b", "u", "s", "X", "https://e.com/")])
    sinks.route(lambda b, i: kept.extend(r.eventId for r in b.collect()), f"{tmp_path}/errors", T0)(df, 3)
    bad = spark.read.option("recursiveFileLookup", "true").json(f"{tmp_path}/errors")
    assert kept == ["a"]
    assert [(r.eventId, r.errors, r.batch_id) for r in bad.collect()] == [("b", ["eventType is unknown"], 3)]


def json_values(spark, path, rows, *others):
    values = sinks.keyed_json(frame(spark, rows)).select("value").union(spark.createDataFrame([(x,) for x in others], "value string"))
    values.coalesce(1).write.mode("append").text(str(path))
    return spark.readStream.schema("value string").text(str(path))


def test_the_whole_job(spark, tmp_path):
    """Values in, tables, archive and quarantine out; a restart takes in what is new."""
    rows = [{**r, "pageUrl": "https://e.com" + r["pageUrl"], "metadata": (1, 2, *[None] * 8)} for r in visits(6)]
    end = row("end", "z", "zs", "PAGE_VIEW", "https://e.com/z", 10 * 60 * MIN)

    def go(new, *others):
        values = json_values(spark, tmp_path / "in", new, *others)
        for q in jobs.start_pipeline(values, str(tmp_path), every=None, as_of_ms=T0 + 11 * 60 * MIN).values():
            q.awaitTermination()

    go(rows, "no json")
    go([end, row("bad", "u", "u", "PAGE_VIEW", "https://e.com/")], '{"eventId": "x"}')
    assert sorted(r.eventId for r in spark.read.parquet(f"{tmp_path}/lake").collect()) == sorted([r["eventId"] for r in rows] + ["end"])
    bad = spark.read.schema("eventId string, errors array<string>").option("recursiveFileLookup", "true").json(f"{tmp_path}/quarantine")
    assert {r.eventId: len(r.errors) for r in bad.collect()} == {None: 6, "x": 5, "bad": 1}
    table = lambda name: sinks.KeyedTable(spark, f"{tmp_path}/tables/{name}").read()
    assert [(r.sessionId, r.pageViewCount, r.clickCount) for r in table("sessions").collect()] == [("s", 3, 3)]
    assert table("page-metrics").agg(F.sum("totalViews")).first()[0] == 4


def test_undelivered_batches_are_kept_and_the_stream_goes_on(spark, tmp_path):
    tries = []

    def flaky(batch, path):
        tries.append(1)
        if len(tries) <= 3:
            raise RuntimeError("no store")
        sinks.archive(batch, path)

    for n in (3, 2):
        write(spark, visits(n, n * 100 * MIN), tmp_path / "in")
        jobs.start_archive(stream(spark, tmp_path / "in"), str(tmp_path), None, write=flaky, first_ms=1).awaitTermination()
    assert len(tries) == 4
    lost = spark.read.option("recursiveFileLookup", "true").json(f"{tmp_path}/undelivered")
    assert (lost.count(), spark.read.parquet(f"{tmp_path}/lake").count()) == (3, 2)


def test_live_series_as_a_stream(spark, tmp_path):
    write(spark, visits(7), tmp_path / "in")
    jobs.start_series(stream(spark, tmp_path / "in"), str(tmp_path), "2 minutes", "1 minute", every=None).awaitTermination()
    from clickweave.operators import live

    got = sinks.KeyedTable(spark, f"{tmp_path}/tables/live-series").read()
    columns = ["windowStart", "windowEnd", "activeUsers", "clicks", "events"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, live.metric_series(frame(spark, visits(7)), "2 minutes", "1 minute").select(*columns).collect()))


def test_all_queries_stop_with_the_first(spark, tmp_path):
    write(spark, visits(3), tmp_path / "in")
    started = {name: stream(spark, tmp_path / "in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/{name}") for name in "ab"}
    spark.streams.resetTerminated()
    running = {"a": started["a"].trigger(processingTime="1 second").start(), "b": started["b"].trigger(availableNow=True).start()}
    jobs.run_until_stopped(spark, running)
    assert not any(q.isActive for q in running.values())
    spark.streams.resetTerminated()


def test_listener_keeps_the_last_reports():
    assert jobs.ProgressListener(keep=5).rows.maxlen == 5


def test_a_query_that_falls_behind_is_reported(caplog):
    class Progress:
        name, runId, batchId, timestamp, durationMs, stateOperators = "q", "r", 10, "2024-01-01T00:00:00.000Z", {"triggerExecution": 5}, []
        numInputRows, inputRowsPerSecond, processedRowsPerSecond = 100, 160.0, 100.0
        sources = [type("Source", (), {"metrics": {"maxOffsetsBehindLatest": "1500"}})]

    class Event:
        progress = Progress

    listener = jobs.ProgressListener()
    with caplog.at_level("INFO"):
        listener.onQueryProgress(Event)
        Progress.inputRowsPerSecond = 149.0
        listener.onQueryProgress(Event)
    assert [r.levelname for r in caplog.records if "rows/s" in r.getMessage()] == ["WARNING"]
    assert sum('"batchId": 10' in r.getMessage() for r in caplog.records) == 2
    assert [r["lag"] for r in listener.rows] == [1500, 1500]


def test_lag_above_a_limit(spark):
    rows = [("a", "r", 0, "2024-01-01T00:00:00.000Z", 5, 1.0, 1.0, 9, 0, 999), ("b", "r", 0, "2024-01-01T00:00:00.000Z", 5, 1.0, 1.0, 9, 0, 1001)]
    assert [r.name for r in jobs.over_lag(spark.createDataFrame(rows, jobs.PROGRESS)).collect()] == ["b"]


def test_streamed_duplicates_are_dropped_within_the_watermark(spark, tmp_path):
    from clickweave.functions import scrub

    for rows in (visits(3), visits(4)):
        write(spark, rows, tmp_path / "in")
        out = scrub.deduplicate(sources.with_watermark(stream(spark, tmp_path / "in"))).select("eventId").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        out.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.eventId for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r["eventId"] for r in visits(4))


def test_published_messages(spark, monkeypatch):
    """What is handed to Spark's Kafka sink, whose package isn't here."""
    seen = {}

    class Writer:
        def format(self, name):
            seen["format"] = name
            return self

        def option(self, key, value):
            seen[key] = value
            return self

        def save(self):
            seen["saved"] = True

    df = frame(spark, visits(2))
    messages = sinks.keyed_json(df)
    monkeypatch.setattr(type(messages), "write", property(lambda self: Writer()))
    sinks.publish(df, "k:9092", "events")
    assert seen == {"format": "kafka", "kafka.bootstrap.servers": "k:9092", "topic": "events", "saved": True}
    assert messages.columns == ["key", "value"]


def test_kafka_options():
    """What is handed to Spark's Kafka source, whose package isn't here."""

    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def option(self, key, value):
            self.seen[key] = value
            return self

        def options(self, **more):
            self.seen |= more
            return self

        def load(self):
            return self

        def selectExpr(self, *columns):
            return self.seen | {"columns": columns}

    class Session:
        readStream = Reader()

    got = sources.kafka_events(Session(), "k:9092", "events", "latest", maxOffsetsPerTrigger="1000")
    assert got == {"format": "kafka", "kafka.bootstrap.servers": "k:9092", "subscribe": "events", "startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "1000", "columns": ("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")}


def test_snapshots_and_lookups_are_pruned(spark, tmp_path):
    from clickweave.operators import curated, live

    frame(spark, visits(4)).write.parquet(str(tmp_path / "ev"))
    ev = spark.read.parquet(str(tmp_path / "ev"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in live.live_snapshot(ev, T0)._jdf.queryExecution().toString()
    maintenance.write_for_lookup(sessions.session_aggregates(frame(spark, visits(4))), str(tmp_path / "s"), "userId")
    table = spark.read.parquet(str(tmp_path / "s"))
    plan = spark._jvm.PythonSQLUtils.explainString(curated.sessions(table, "u", "2024-01-01", "2024-01-02")._jdf.queryExecution(), "formatted")
    assert "EqualTo(userId,u)" in plan
    assert "PartitionFilters: [isnotnull(date" in plan
    assert curated.sessions(table, "u", "2024-01-01", "2024-01-02").count() == 1


def test_archive_reading_retention_and_compaction(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = [row(f"e{k}", "u", "s", "PAGE_VIEW", "/", at) for k, at in enumerate((59 * MIN, 61 * MIN, 25 * 60 * MIN))]
    for r in rows:
        sinks.archive(frame(spark, [r]), path)
    sinks.archive(frame(spark, rows[:1]), path)
    start, end = (dt.datetime(2024, 1, 1, h, tzinfo=dt.UTC) for h in (0, 0))
    pruned = spark.read.parquet(path).filter(maintenance.partition_predicate(start, end))
    assert pruned.count() == 2
    assert "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().toString() or "PartitionFilters" in pruned._jdf.queryExecution().toString()
    assert maintenance.compact(spark, path, str(tmp_path / "small")).count() == 4
    assert maintenance.drop_before(spark, path, dt.datetime(2024, 1, 1, 1)) == 1
    left = spark.read.parquet(path)
    assert sorted(r.eventId for r in left.collect()) == ["e1", "e2"]
    assert left.first().metadata is None


def test_reingest_and_lookup_layout(spark, tmp_path):
    df = frame(spark, [row("a", "u", "s", "PAGE_VIEW", "https://e.com/"), row("b", "u", "s", "PAGE_VIEW", "https://e.com/", 3_600_000)])
    good, bad = validation.split_valid(df, T0)
    assert [r.eventId for r in maintenance.reingest(bad.union(bad), good, T0 + 3_600_000).collect()] == ["b"]
    maintenance.write_for_lookup(sessions.session_aggregates(df), str(tmp_path / "s"), "userId")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_arrow_export(spark):
    from clickweave.operators import live

    df = frame(spark, [row("a", "u", "s", "CLICK", "/a")])
    one, pages_table = sinks.snapshot_arrow(live.live_snapshot(df, T0), live.trending_pages(df, T0))
    assert one.column_names == ["activeUsers", "clicksPerSecond", "eventRate", "computedAt"]
    assert pages_table.to_pylist() == [{"pageUrl": "/a", "viewCount": 1}]
