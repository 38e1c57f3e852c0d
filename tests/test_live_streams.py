"""Streams that keep live metrics, bounce rates, session ids and the archive; lookups over what streams wrote."""

import datetime as dt
import random
import time

import pytest
from compare import DATA
from events import T0, frame, row
from pyspark.sql import functions as F
from test_streaming import MIN, stream, visits, write

from clickweave.functions import scrub
from clickweave.operators import curated, live, maintenance, pages, sessions
from clickweave.plans import queries
from clickweave.sources.events import micros, with_watermark
from clickweave.streaming import jobs, sinks, stateful


def many(rng, n, users=40, span=600, page=lambda k: f"/{k}"):
    """Events in minutes of a span, some of them at once, a few without a user."""
    return [row(f"e{k}", None if k % 29 == 0 else f"u{rng.randrange(users)}", f"s{rng.randrange(9)}", rng.choice(["PAGE_VIEW", "CLICK"]), page(int(rng.paretovariate(1)) % 30), rng.randrange(span) * MIN + rng.choice([0, 1, 59_999])) for k in range(n)]


# --- panes -----------------------------------------------------------------------------------------------------------------


def sliding(events, width, slide):
    """The definition: every event in every window."""
    out = events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count_distinct("userId").alias("users"), F.count(F.when(F.col("eventType") == "CLICK", 1)).alias("clicks"), F.count("*").alias("events"))
    return sorted(map(tuple, out.select("w.start", "w.end", "users", "clicks", "events").collect()))


@pytest.mark.parametrize("width,slide", [("15 minutes", "1 minute"), ("10 minutes", "10 minutes"), ("1 hour", "25 minutes"), ("7 minutes", "3 minutes"), ("90 seconds", "1 minute")])
def test_series_by_panes_equal_sliding_windows(spark, width, slide):
    events = frame(spark, many(random.Random(1), 500))
    got = live.metric_series(events, width, slide).select("windowStart", "windowEnd", "activeUsers", "clicks", "events")
    assert sorted(map(tuple, got.collect())) == sliding(events, width, slide)
    assert live.metric_series(events.limit(0), width, slide).count() == 0


def test_events_are_not_repeated_for_windows_before_they_are_counted(spark):
    plan = live.metric_series(frame(spark, many(random.Random(1), 50)), "15 minutes", "1 minute")._jdf.queryExecution().optimizedPlan().toString()
    # windows are made of counts: below the explode lie the counts of panes, the distance to a user's pane before, and the counts by user and pane
    below = plan[plan.index("Generate explode") :]
    assert below.count("Aggregate") == 2 and below.count("Window") == 1 and "Expand" not in plan


def test_panes_answer_snapshot_trending_and_series(spark):
    events = frame(spark, many(random.Random(2), 3000, users=700))
    panes = live.live_panes(events, "5 minutes").persist()
    as_of = T0 + 480 * MIN
    at = F.timestamp_millis(F.lit(as_of))
    inside = events.filter((F.col("timestamp") >= as_of - 240 * MIN) & (F.col("timestamp") < as_of))
    expected = inside.groupBy("pageUrl").agg(F.count("*").cast("int").alias("n")).orderBy(F.desc("n"), "pageUrl").limit(5)
    assert [tuple(r) for r in live.trending_of(panes, at, 240 * MIN, 5).collect()] == [tuple(r) for r in expected.collect()]
    one = live.snapshot_of(panes, at, 240 * MIN, 60 * MIN, 60 * MIN).first()
    users = inside.agg(F.count_distinct("userId")).first()[0]
    assert abs(one.activeUsers - users) <= 0.05 * users
    hour = inside.filter(F.col("timestamp") >= as_of - 60 * MIN)
    assert (one.eventRate, one.clicksPerSecond) == (pytest.approx(hour.count() / 3600), pytest.approx(hour.filter("eventType = 'CLICK'").count() / 3600))
    exact = {r.windowStart: r for r in live.metric_series(events, "2 hours", "30 minutes").collect()}
    rough = live.series_of(panes, "2 hours", "30 minutes").collect()
    assert len(rough) == len(exact)
    for r in rough:
        e = exact[r.windowStart]
        assert (r.windowEnd, r.clicks, r.events) == (e.windowEnd, e.clicks, e.events)
        assert abs(r.activeUsers - e.activeUsers) <= 0.05 * e.activeUsers + 1
    nothing = panes.limit(0)
    assert live.trending_of(nothing, at).count() == 0 and live.series_of(nothing).count() == 0
    assert tuple(live.snapshot_of(nothing, at).first())[:3] == (0, 0.0, 0.0)


def test_live_stream_over_several_files_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(many(rng, 300, span=90), key=lambda r: r["timestamp"])
    for k in range(0, 300, 100):
        write(spark, rows[k : k + 100], tmp_path / "in")
        q = jobs.start_live(stream(spark, tmp_path / "in"), str(tmp_path), "1 minute", "100 minutes", every=None)
        q.awaitTermination()
    table = sinks.KeyedTable(spark, f"{tmp_path}/tables/live-panes")
    batch = live.live_panes(frame(spark, rows))
    as_of = F.timestamp_millis(F.lit(T0 + 60 * MIN))
    for ask in (lambda p: live.trending_of(p, as_of), lambda p: live.snapshot_of(p, as_of), lambda p: live.series_of(p).orderBy("windowStart")):
        assert [tuple(r) for r in ask(table.read()).collect()] == [tuple(r) for r in ask(batch).collect()]
    start = dt.datetime.fromtimestamp(T0 / 1000, dt.UTC)
    assert table.between(start, start).count() == table.read().count()
    assert table.between(start - dt.timedelta(days=9), start - dt.timedelta(days=3)) is None


def test_series_of_a_stream_change_where_panes_do(spark, tmp_path):
    rows = sorted(many(random.Random(4), 200, users=5, span=60), key=lambda r: r["timestamp"])
    for part in (rows[:120], rows[120:], [row("late", "u9", "s", "CLICK", "/1", 30 * MIN)]):
        write(spark, part, tmp_path / "in")
        jobs.start_series(stream(spark, tmp_path / "in"), str(tmp_path), "10 minutes", "4 minutes", "2 hours", every=None).awaitTermination()
    got = sinks.KeyedTable(spark, f"{tmp_path}/tables/live-series").read()
    events = frame(spark, [*rows, row("late", "u9", "s", "CLICK", "/1", 30 * MIN)])
    assert sorted(map(tuple, got.select("windowStart", "windowEnd", "activeUsers", "clicks", "events").collect())) == sliding(events, "10 minutes", "4 minutes")


def test_intervals_of_fixed_length():
    assert (micros("5 minutes"), micros("1 Hour"), micros("250 milliseconds")) == (300_000_000, 3_600_000_000, 250_000)
    for wrong in ("1 month", "5", "0 minutes"):
        with pytest.raises(ValueError):
            micros(wrong)


# --- bounce rates --------------------------------------------------------------------------------------------------------


def test_chained_bounce_rates_over_several_files_with_late_rows(spark, tmp_path):
    """Two steps with state: windows close once, late rows are left out, and what is written doesn't change any more."""
    one = lambda name, user, page, at, kind="PAGE_VIEW": row(name, user, f"s-{user}", kind, page, at * MIN)
    first = [one("a", "u1", "/a", 0), one("b", "u2", "/a", 1), one("c", "u2", "/b", 2), one("d", "u3", "/b", 3)]
    second = [one("e", "u4", "/a", 65), one("f", "u4", "/a", 66)]
    late = [one("g", "u5", "/a", 4), one("h", "u6", "/c", 200)]  # by now the watermark is past g
    end = [one("z", "u9", "/z", 900)]
    for part in (first, second, late, end, [one("y", "u9", "/z", 1900)]):
        write(spark, part, tmp_path / "in")
        q = jobs._start(pages.closing_bounces(with_watermark(stream(spark, tmp_path / "in")), "30 minutes", "1 hour"), "page-bounces", str(tmp_path), "append", None)
        q.awaitTermination()
    kept = frame(spark, first + second + late[1:] + end)
    expected = pages.closing_bounces(kept, "30 minutes", "1 hour")
    columns = ["pageUrl", "windowStart", "windowEnd", "sessions", "bounceRate"]
    got = sinks.KeyedTable(spark, f"{tmp_path}/tables/page-bounces").read()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))
    assert {(r.pageUrl, r.sessions, r.bounceRate) for r in got.collect()} >= {("/a", 2, 0.5), ("/b", 2, 0.5), ("/a", 1, 0.0)}


# --- session ids and bursts ------------------------------------------------------------------------------------------------


def settled(spark, tmp_path, make, batches):
    for rows in batches:
        write(spark, rows, tmp_path / "in")
        out = make(stream(spark, tmp_path / "in")).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream(spark, tmp_path / "in").schema).parquet(f"{tmp_path}/out")


def shuffled_batches(rows, rng, late_minutes=8):
    """Rows in files as they would come in, up to some minutes late, and an event that lets the watermark pass all."""
    rows = sorted(rows, key=lambda r: r["timestamp"] + rng.randrange(late_minutes * MIN))
    return [rows[k : k + 40] for k in range(0, len(rows), 40)] + [[row("end", "zz", "zz", "PAGE_VIEW", "/", 10_000 * MIN)]]


def test_streamed_session_ids_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = many(rng, 160, users=6, span=400)
    got = settled(spark, tmp_path, lambda df: stateful.assign_sessions_stream(df, gap_ms=20 * MIN), shuffled_batches(rows, rng))
    expected = scrub.assign_sessions(frame(spark, rows), 20 * MIN)
    columns = ["eventId", "userId", "eventType", "timestamp", "ts", "sessionId", "metadata"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))
    assert len({r.sessionId for r in got.collect()}) > 30


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [row(f"c{k}", f"u{k // 80}", "s", "CLICK" if k % 5 else "HOVER", "/", k // 4 * 700 + rng.choice([0, 199, 200, 201, 399, 400]), targetElement="b" if k % 7 else None) for k in range(160)]
    got = settled(spark, tmp_path, stateful.debounce_stream, shuffled_batches(rows, rng))
    expected = scrub.debounce(frame(spark, rows))
    key = lambda df: sorted((r.eventId, r.timestamp, r.ts) for r in df.filter("eventId <> 'end'").collect())
    # clicks of one burst at one time: the last by eventId stays in both
    assert key(got) == key(expected)
    assert len(key(got)) < 0.8 * len(rows)


# --- the archive -------------------------------------------------------------------------------------------------------------


def test_a_batch_that_comes_again_repeats_nothing(spark, tmp_path):
    events = lambda a, b: frame(spark, [row(f"e{k}", "u", "s", "CLICK", "/", k * 20 * MIN) for k in range(a, b)])
    lake, ids = str(tmp_path / "lake"), lambda: sorted(r.eventId for r in spark.read.parquet(str(tmp_path / "lake")).collect())
    sinks.archive_batch(events(0, 5), 0, lake)
    sinks.archive_batch(events(5, 9), 1, lake)
    assert ids() == [f"e{k}" for k in range(9)]
    sinks.archive_batch(events(5, 9).repartition(7), 1, lake)  # its commit was lost, and it is replayed in other parts
    assert ids() == [f"e{k}" for k in range(9)]
    assert {r.hour for r in spark.read.parquet(lake).select("hour").collect()} == {0, 1, 2}


def test_a_lost_commit_of_the_stream_repeats_nothing(spark, tmp_path):
    """The checkpoint loses the commit of the last batch, as if the driver had died between writing and committing."""
    for n in (4, 3):
        write(spark, visits(n, n * 100 * MIN), tmp_path / "in")
        jobs.start_archive(stream(spark, tmp_path / "in"), str(tmp_path), None).awaitTermination()
    commits = tmp_path / "checkpoints" / "archive" / "commits"
    for f in (commits / "1", commits / ".1.crc"):
        f.unlink(missing_ok=True)
    jobs.start_archive(stream(spark, tmp_path / "in"), str(tmp_path), None).awaitTermination()
    assert (commits / "1").exists()
    got = [r.eventId for r in spark.read.parquet(f"{tmp_path}/lake").collect()]
    assert len(got) == len(set(got)) == 7


def test_an_undelivered_batch_leaves_nothing_in_the_lake(spark, tmp_path, monkeypatch):
    whole = sinks.archive_batch

    def breaks(batch, batch_id, path):  # half of the rows are there before the store is lost
        whole(batch.filter("eventType = 'CLICK'"), batch_id, path)
        raise OSError("store lost")

    monkeypatch.setattr(jobs, "archive_batch", breaks)
    write(spark, visits(6, 0) + visits(6, 300 * MIN), tmp_path / "in")
    jobs.start_archive(stream(spark, tmp_path / "in"), str(tmp_path), None, first_ms=1).awaitTermination()
    assert not list((tmp_path / "lake").rglob("*.parquet"))
    monkeypatch.setattr(jobs, "archive_batch", whole)
    write(spark, visits(3, 600 * MIN), tmp_path / "in")
    jobs.start_archive(stream(spark, tmp_path / "in"), str(tmp_path), None, first_ms=1).awaitTermination()
    kept = spark.read.option("recursiveFileLookup", "true").json(f"{tmp_path}/undelivered")
    assert (kept.count(), spark.read.parquet(f"{tmp_path}/lake").count()) == (12, 3)


def test_streams_with_checkpoints_of_their_own_share_a_lake(spark, tmp_path):
    """A new checkpoint counts its batches from 0 again, and they aren't taken for those of the old one."""
    write(spark, visits(4), tmp_path / "in")
    jobs.start_archive(stream(spark, tmp_path / "in"), str(tmp_path), None).awaitTermination()
    jobs.start_archive(stream(spark, tmp_path / "in"), str(tmp_path), None).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/lake").count() == 4
    (tmp_path / "checkpoints").rename(tmp_path / "old")
    write(spark, visits(3, 900 * MIN, "t"), tmp_path / "in2")
    jobs.start_archive(stream(spark, tmp_path / "in2"), str(tmp_path), None).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/lake").count() == 7


# --- lookups -------------------------------------------------------------------------------------------------------------


def test_only_changed_days_are_laid_out_again(spark, tmp_path):
    table = sinks.KeyedTable(spark, f"{tmp_path}/t")
    day = 24 * 60 * MIN
    made = lambda rows: sessions.session_aggregates(frame(spark, rows))
    first = [row(f"a{k}", f"u{k % 3}", f"s{k}", "PAGE_VIEW", "/", k * day) for k in range(4)]
    table.merge(made(first), 0)
    target = f"{tmp_path}/lookup"
    days = sinks.lay_out(table, target, "userId")
    assert len(days) == 4 and sinks.lay_out(table, target, "userId") == []
    table.merge(made([row("b", "u9", "s9", "PAGE_VIEW", "/", 2 * day + MIN)]), 1)
    assert sinks.lay_out(table, target, "userId") == days[2:3]
    rows = spark.read.parquet(target)
    assert sorted(r._compositeKey for r in rows.collect()) == sorted(r._compositeKey for r in table.read().collect())
    table.merge(made(first[1:2]), 2)  # the same rows again are a change of their day only
    assert sinks.lay_out(table, target, "userId") == days[1:2]
    plan = curated.sessions(rows, "u1", "2024-01-15 00:00:00", "2024-01-16 00:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(userId,u1)" in plan


def test_pages_by_the_last_row_equal_pages_by_number(spark, tmp_path):
    rows = [row(f"a{k}", f"u{k % 3}", f"s{k}", "PAGE_VIEW", "/", (k // 4) * 600 * MIN) for k in range(37)]  # four sessions start at once
    maintenance.write_for_lookup(sessions.session_aggregates(frame(spark, rows)), str(tmp_path / "s"), "userId")
    df, after = spark.read.parquet(str(tmp_path / "s")), None
    for number in range(6):
        want = curated.page_of(df, number, 7).collect()
        got = curated.page_after(df, after, 7).collect()
        assert got == want
        after = (got[-1].windowStart, got[-1]._compositeKey) if got else after
    plan = curated.page_after(df, (dt.datetime(2024, 1, 15), "x"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "LessThanOrEqual(windowStart" in plan
    with pytest.raises(ValueError):
        curated.page_after(df, None, 0)


def test_reingest_reads_the_hours_of_its_events_only(spark, tmp_path):
    rows = [row(f"e{k}", "u", "s", "PAGE_VIEW", "https://e.com/", k * 30 * MIN) for k in range(20)]
    sinks.archive(frame(spark, rows[:10]), str(tmp_path / "lake"))
    lake = spark.read.parquet(str(tmp_path / "lake"))
    bad = frame(spark, [rows[4], rows[5], rows[11], rows[11]])  # of two hours, half of them archived by now
    out = maintenance.reingest(bad, lake, T0 + 20 * 30 * MIN)
    assert [r.eventId for r in out.collect()] == ["e11"]
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [(" in plan or "PartitionFilters: [cast" in plan or "IN (" in plan.split("PartitionFilters")[1][:400]
    read = maintenance.hours_of(bad, lake)
    assert {r.hour for r in read.select("hour").collect()} == {2}
    assert maintenance.hours_of(bad, lake, most=1).count() == 6  # all hours from the first to the last
    assert maintenance.hours_of(bad.limit(0), lake).count() == 0
    assert maintenance.reingest(bad.limit(0), lake, T0).count() == 0


# --- the jobs ----------------------------------------------------------------------------------------------------------------


class Report:
    """A progress report."""

    def __init__(self, name, batch, rows, late=0, lag=0):
        self.name, self.runId, self.batchId, self.numInputRows = name, "r", batch, rows
        self.timestamp, self.durationMs, self.inputRowsPerSecond, self.processedRowsPerSecond = f"2024-01-01T00:00:{batch:02d}.000Z", {"triggerExecution": 5}, 1.0, 1.0
        self.stateOperators = [type("State", (), {"numRowsDroppedByWatermark": late})]
        self.sources = [type("Source", (), {"metrics": {"maxOffsetsBehindLatest": str(lag)}})]


def test_totals_stay_right_beyond_what_is_kept(spark, tmp_path):
    listener = jobs.ProgressListener(keep=3)
    listener.onQueryProgress(type("E", (), {"progress": Report("stopped", 1, 7)}))
    for k in range(10):
        listener.onQueryProgress(type("E", (), {"progress": Report("q", k, 10 * k, late=1, lag=500 if k == 2 else 0)}))
        if k == 4:
            jobs.save_progress(spark, listener, str(tmp_path / "p"))
    assert len(listener.rows) == 3
    jobs.save_progress(spark, listener, str(tmp_path / "p"))
    jobs.save_progress(spark, listener, str(tmp_path / "p"))  # nothing new
    for progress in (jobs.job_progress(spark, listener), spark.read.parquet(str(tmp_path / "p"))):
        got = {r.name: r for r in jobs.counters(progress).collect()}
        assert (got["q"].processed, got["q"].batches, got["q"].late, got["q"].maxLag) == (450, 10, 10, 500)
        assert got["q"].lastWrite == dt.datetime(2024, 1, 1, 0, 0, 9)
        assert (got["stopped"].processed, got["stopped"].batches) == (7, 1)
        # a query that stopped long ago is still named
        assert {r.name for r in jobs.stalled(progress, "2024-01-01 00:02:05", 1).collect()} == {"stopped"}


def test_jobs_under_their_timed_trigger(spark, tmp_path):
    write(spark, visits(6), tmp_path / "in")
    started = jobs.start_jobs(stream(spark, tmp_path / "in"), str(tmp_path), every="1 second")
    try:
        for q in started.values():
            q.processAllAvailable()
        write(spark, [row("end", "z", "zs", "PAGE_VIEW", "/z", 10 * 60 * MIN)], tmp_path / "in")
        until = time.time() + 60
        table = lambda name: sinks.KeyedTable(spark, f"{tmp_path}/tables/{name}").read()
        while time.time() < until and (table("sessions") is None or table("page-bounces") is None or table("user-journeys") is None):
            time.sleep(1)
        assert [(r.sessionId, r.pageViewCount) for r in table("sessions").collect()] == [("s", 3)]
        assert table("page-metrics").agg(F.sum("totalViews")).first()[0] == 4
        assert table("page-bounces").agg(F.sum("sessions")).first()[0] == 3
        assert all(q.isActive for q in started.values())
    finally:
        for q in started.values():
            q.stop()


def test_the_whole_job_scrubs_before_it_validates(spark, tmp_path):
    rows = [row("a", "u", "s", "PAGE_VIEW", "https://e.com/a", 0), row("b", "u", "s", "CLICK", "https://e.com/a", MIN, targetElement="input#Password"), row("c", "u", "s", "CLICK", "https://e.com/a", MIN, targetElement="<b>go</b>", referrerUrl="ftp://x")]
    sinks.keyed_json(frame(spark, [r | {"metadata": (1, 2, 3.5, *[None] * 7)} for r in rows])).select("value").write.text(str(tmp_path / "in"))
    for q in jobs.start_pipeline(spark.readStream.schema("value string").text(str(tmp_path / "in")), str(tmp_path), every=None, as_of_ms=T0 + 60 * MIN, salt="pepper").values():
        q.awaitTermination()
    got = {r.eventId: r for r in spark.read.parquet(f"{tmp_path}/lake").collect()}
    assert set(got) == {"a", "c"}
    assert (got["c"].targetElement, got["c"].referrerUrl, got["c"].metadata.scrollDepth) == ("go", None, 1.0)
    assert len(got["a"].userId) == 64
    assert not [f for f in (tmp_path / "quarantine").rglob("*.json") if f.stat().st_size] if (tmp_path / "quarantine").exists() else True
    assert sinks.KeyedTable(spark, f"{tmp_path}/tables/live-panes").read().agg(F.sum("events")).first()[0] == 2


def test_kept_live_table_is_pruned_by_day(spark):
    panes, _ = queries.live_table(spark, f"{DATA}/sf0.001")
    days = {r[0] for r in panes.select(F.to_date("windowStart")).distinct().collect()}
    assert 0 < len(days) <= 6


def test_the_whole_job_reads_its_source_once(spark, tmp_path):
    rows = [row(f"e{k}", "u", "s", "PAGE_VIEW", "https://e.com/a", k * MIN) for k in range(5)] + [row(f"b{k}", "u", "s", "NONE", "https://e.com/a", k * MIN) for k in range(3)]
    sinks.keyed_json(frame(spark, rows)).select("value").write.text(str(tmp_path / "in"))
    started = jobs.start_pipeline(spark.readStream.schema("value string").text(str(tmp_path / "in")), str(tmp_path), every=None, as_of_ms=T0 + 60 * MIN)
    for q in started.values():
        q.awaitTermination()
    taken = {name: sum(p.numInputRows for p in q.recentProgress) for name, q in started.items()}
    assert taken.pop("intake") == 8
    assert taken.pop("quarantine") == 3
    assert set(taken.values()) == {5}  # all eight, parsed and judged again by each, before
    assert spark.read.parquet(f"{tmp_path}/lake").count() == 5


def test_nothing_rejected_leaves_an_empty_quarantine(spark, tmp_path):
    sinks.keyed_json(frame(spark, [row("e", "u", "s", "PAGE_VIEW", "https://e.com/a", 0)])).select("value").write.text(str(tmp_path / "in"))
    for q in jobs.start_pipeline(spark.readStream.schema("value string").text(str(tmp_path / "in")), str(tmp_path), every=None, as_of_ms=T0 + MIN).values():
        q.awaitTermination()
    assert spark.read.schema("eventId string").option("recursiveFileLookup", "true").json(f"{tmp_path}/quarantine").count() == 0


def test_a_timed_pipeline_follows_its_intake(spark, tmp_path):
    write = lambda rows: sinks.keyed_json(frame(spark, rows)).select("value").write.mode("append").text(str(tmp_path / "in"))
    write([row("a", "u", "s", "PAGE_VIEW", "https://e.com/a", 0)])
    started = jobs.start_pipeline(spark.readStream.schema("value string").text(str(tmp_path / "in")), str(tmp_path), every="1 second", as_of_ms=T0 + 60 * MIN)
    try:
        write([row("b", "u", "s", "PAGE_VIEW", "https://e.com/a", MIN), row("c", "u", "s", "NONE", "https://e.com/a", MIN)])
        started["intake"].processAllAvailable()
        started["archive"].processAllAvailable()
        started["quarantine"].processAllAvailable()
        assert sorted(r.eventId for r in spark.read.parquet(f"{tmp_path}/lake").collect()) == ["a", "b"]
        assert [r.eventId for r in spark.read.schema("eventId string").option("recursiveFileLookup", "true").json(f"{tmp_path}/quarantine").collect()] == ["c"]
        assert all(q.isActive for q in started.values())
    finally:
        for q in started.values():
            q.stop()


def test_steps_with_state_run_once_in_a_batch(spark, tmp_path):
    write(spark, [row(f"e{k}", "u", "s", "PAGE_VIEW", "/a", k * MIN) for k in range(5)], tmp_path / "in")
    q = jobs.start_live(stream(spark, tmp_path / "in"), str(tmp_path), every=None)
    q.awaitTermination()
    assert q.recentProgress[0].stateOperators[0].numRowsUpdated == 5  # 10 before: a merge ran them for rows with a key and again for those without


def test_state_has_few_partitions_and_leaves_the_session_as_it_was(spark, tmp_path):
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, "200")
    try:
        q = jobs.start_jobs(queries.stream_events(spark, f"{DATA}/sf0.001"), str(tmp_path), "12 hours", "1 day", every=None, names=["page-metrics"])["page-metrics"]
        q.awaitTermination()
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, was)
    assert 0 < len([f for f in (tmp_path / "checkpoints/page-metrics/state/0").iterdir() if f.name.isdigit()]) <= 2 * spark.sparkContext.defaultParallelism


def test_a_lookup_runs_the_job_of_its_table_only(spark, monkeypatch):
    started = []
    whole = jobs._start
    monkeypatch.setattr(jobs, "_start", lambda df, name, *rest: started.append(name) or whole(df, name, *rest))
    monkeypatch.setattr(queries, "_WRITTEN", {})
    assert queries.QUERIES["sq13_top_windows"](spark, f"{DATA}/sf0.001").count() > 0
    assert started == ["page-metrics"]
    queries.QUERIES["sq6_session_by_id"](spark, f"{DATA}/sf0.001")
    queries.QUERIES["sq1_sessions_page"](spark, f"{DATA}/sf0.001")
    assert started == ["page-metrics", "sessions"]
